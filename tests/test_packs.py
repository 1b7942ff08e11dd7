import json

import pytest

from corvid.packs import registry

PROJECTS = {
    "fastapi": ({
        "app/main.py": "from fastapi import FastAPI\nfrom .routers.things import router as things\nfrom .routers import lost\napp = FastAPI()\nAPI = '/api'\napp.include_router(things, prefix=API + '/v1')\nname = input()\n@app.get(f'/{name}')\ndef moving(): return 1\n@app.get('/health', tags=['ops'])\ndef health(): return {'ok': True}\nclient.get('/decoy')\n",
        "app/routers/things.py": "from typing import Optional\nfrom fastapi import APIRouter, Depends, HTTPException, Query\nfrom fastapi.security import HTTPBearer\nfrom pydantic import BaseModel, Field\nbearer = HTTPBearer()\nclass Base(BaseModel):\n    title: str = Field(min_length=2)\nclass Thing(Base):\n    price: Optional[float] = None\n    tags: list[str] = []\nrouter = APIRouter(prefix='/things')\n@router.get('/{thing_id:int}', response_model=Thing)\ndef one(thing_id: int, q: str | None = Query(None, alias='query'), token=Depends(bearer)):\n    raise HTTPException(status_code=404)\n@router.post('', status_code=201)\ndef make(body: Thing) -> Thing: ...\n",
        "app/routers/lost.py": "from fastapi import APIRouter\nlonely = APIRouter()\n@lonely.get('/never')\ndef never(): ...\n",
    }, {("get", "/api/v1/things/{thing_id}"), ("post", "/api/v1/things"), ("get", "/health")}, {"dynamic-path", "unreachable-router"}),
    "flask": ({
        "app.py": "from flask import Flask, Blueprint, jsonify, request\napp = Flask(__name__)\nbp = Blueprint('b', __name__, url_prefix='/b')\nlost = Blueprint('l', __name__)\napp.register_blueprint(bp)\n@app.route('/x/<int:n>', methods=['GET', 'POST'])\ndef x(n):\n    if request.method == 'POST':\n        return jsonify(made=1), 201\n    return {'n': request.args.get('q', type=int)}\n@bp.get('/y')\ndef y(): return jsonify([1])\n@lost.get('/z')\ndef z(): return ''\n@app.get('/x/<n>')\ndef again(n): return ''\n",
    }, {("get", "/x/{n}"), ("post", "/x/{n}"), ("get", "/b/y")}, {"unreachable-blueprint", "duplicate-route"}),
    "starlette": ({"a.py": "from starlette.applications import Starlette\nfrom starlette.routing import Route, Mount, WebSocketRoute\nfrom starlette.responses import JSONResponse\nasync def home(request): return JSONResponse({'a': 1})\nsub = [Route('/in/{k:int}', home, methods=['POST'])]\napp = Starlette(routes=[Route('/', home), Mount('/m', routes=sub), WebSocketRoute('/ws', home)])\n"}, {("get", "/"), ("post", "/m/in/{k}"), ("get", "/ws")}, set()),
    "djangorestframework": ({
        "proj/urls.py": "from django.urls import path, include\nurlpatterns = [path('api/', include('shop.urls'))]\n",
        "shop/urls.py": "from django.urls import path\nfrom rest_framework.routers import DefaultRouter\nfrom .views import BookViewSet, Ping\nrouter = DefaultRouter()\nrouter.register('books', BookViewSet)\nurlpatterns = router.urls + [path('ping/<int:n>/', Ping.as_view())]\n",
        "shop/views.py": "from rest_framework import viewsets, serializers\nfrom rest_framework.views import APIView\nclass BookSerializer(serializers.Serializer):\n    title = serializers.CharField()\nclass BookViewSet(viewsets.ReadOnlyModelViewSet):\n    serializer_class = BookSerializer\nclass Ping(APIView):\n    def get(self, request, n): ...\n",
    }, {("get", "/api/books/"), ("get", "/api/books/{id}/"), ("get", "/api/ping/{n}/")}, set()),
    "express": ({
        "src/app.js": "const express = require('express');\nconst items = require('./items');\nconst app = express();\napp.use('/v1', items); // app.get('/comment', x)\napp.get('/health', (req, res) => res.send('ok'));\naxios.get('/decoy');\napp.listen(4000);\n",
        "src/items.js": "const { Router } = require('express');\nconst router = Router();\nrouter.get('/items/:itemId', (req, res) => { const a = req.query.page; res.json({ id: 1, name: 'x' }); });\nrouter.post('/items', make);\nfunction make(req, res) { res.status(201).json({ title: req.body.title }); }\nrouter.route('/both').get(make).delete(make);\nmodule.exports = router;\n",
        "src/lost.js": "const { Router } = require('express');\nconst lonely = Router();\nlonely.get('/never', (req, res) => res.end());\n",
    }, {("get", "/v1/items/{itemId}"), ("post", "/v1/items"), ("get", "/health"), ("get", "/v1/both"), ("delete", "/v1/both")}, {"unreachable-router"}),
    "koa": ({"a.js": "const Koa = require('koa'); const Router = require('@koa/router');\nconst app = new Koa();\nconst router = new Router({ prefix: '/k' });\nrouter.get('/u/:id', ctx => { ctx.body = { id: 1 }; });\napp.use(router.routes());\n"}, {("get", "/k/u/{id}")}, set()),
    "hono": ({"a.ts": "import { Hono } from 'hono'\nconst app = new Hono()\nconst sub = new Hono()\nsub.get('/s/:id', (c) => c.json({ a: 1 }, 201))\napp.route('/api', sub)\napp.post('/p', (c) => c.text('x'))\n"}, {("get", "/api/s/{id}"), ("post", "/p")}, set()),
    "elysia": ({"a.ts": "import { Elysia } from 'elysia'\nconst app = new Elysia({ prefix: '/e' })\napp.get('/x/:id', () => 'hi')\n"}, {("get", "/e/x/{id}")}, set()),
    "fastify": ({"a.js": "const fastify = require('fastify')();\nasync function plug(instance, opts) { instance.get('/in', async (req, reply) => reply.send({ a: 1 })); }\nfastify.register(plug, { prefix: '/p' });\nfastify.route({ method: ['GET', 'PUT'], url: '/r/:id', handler: (req, reply) => reply.code(201).send({ ok: true }) });\n"}, {("get", "/p/in"), ("get", "/r/{id}"), ("put", "/r/{id}")}, set()),
    "nest": ({"c.ts": "import { Controller, Get } from '@nestjs/common';\n@Controller('cats')\nexport class Cats {\n  @Get(':id')\n  one(@Param('id') id: string, @Query('full') full?: string) { return { id: 1 }; }\n  @Post()\n  async make(@Body() dto: X) { return {}; }\n}\n", "main.ts": "app.setGlobalPrefix('api');"}, {("get", "/api/cats/{id}"), ("post", "/api/cats")}, set()),
    "nextjs": ({"app/api/users/[id]/route.ts": "export async function GET(req) { return Response.json({ a: 1 }) }\nexport const DELETE = async () => new Response(null)", "pages/api/legacy.ts": "export default function h(req, res) { res.status(200).json({}) }", "app/(shop)/api/all/[...rest]/route.ts": "export async function POST() {}"}, {("get", "/api/users/{id}"), ("delete", "/api/users/{id}"), ("get", "/api/legacy"), ("post", "/api/all/{rest}")}, set()),
    "gin": ({"main.go": 'package main\nimport "github.com/gin-gonic/gin"\ntype Item struct {\n\tID int64 `json:"id"`\n\tNote *string `json:"note,omitempty"`\n}\nfunc main() {\n\tr := gin.Default()\n\tv1 := r.Group("/v1")\n\tv1.GET("/items/:id", getItem)\n\tregister(v1)\n\thttp.Get("/decoy")\n}\nfunc register(rg *gin.RouterGroup) {\n\trg.POST("/items", func(c *gin.Context) {\n\t\tvar in Item\n\t\tc.ShouldBindJSON(&in)\n\t\tc.JSON(http.StatusCreated, in)\n\t})\n}\nfunc getItem(c *gin.Context) {\n\tq := c.Query("q")\n\tc.JSON(200, gin.H{"q": q, "n": 1})\n}\n'}, {("get", "/v1/items/{id}"), ("post", "/v1/items")}, set()),
    "echo": ({"main.go": 'package main\nfunc main() {\n\te := echo.New()\n\tg := e.Group("/g")\n\tg.PUT("/a/:id", h)\n}\nfunc h(c echo.Context) error { return c.NoContent(http.StatusNoContent) }\n'}, {("put", "/g/a/{id}")}, set()),
    "fiber": ({"main.go": 'package main\nfunc main() {\n\tapp := fiber.New()\n\tapp.Get("/f/:id", func(c *fiber.Ctx) error { return c.Status(202).JSON(fiber.Map{"a": 1}) })\n}\n'}, {("get", "/f/{id}")}, set()),
    "chi": ({"main.go": 'package main\nfunc main() {\n\tr := chi.NewRouter()\n\tr.Route("/articles", func(r chi.Router) {\n\t\tr.Get("/", list)\n\t\tr.Route("/{id:[0-9]+}", func(r chi.Router) {\n\t\t\tr.Delete("/", list)\n\t\t})\n\t})\n\tr.Mount("/admin", adminRouter())\n}\nfunc adminRouter() http.Handler {\n\tr := chi.NewRouter()\n\tr.Get("/stats", list)\n\treturn r\n}\nfunc list(w http.ResponseWriter, r *http.Request) { http.Error(w, "no", 404) }\n'}, {("get", "/articles"), ("delete", "/articles/{id}"), ("get", "/admin/stats")}, set()),
    "gorillamux": ({"main.go": 'package main\nfunc main() {\n\tr := mux.NewRouter()\n\tr.HandleFunc("/b/{k:[a-z]+}", h).Methods("GET", "POST")\n}\nfunc h(w http.ResponseWriter, r *http.Request) { json.NewEncoder(w).Encode(map[string]any{"a": 1}) }\n'}, {("get", "/b/{k}"), ("post", "/b/{k}")}, set()),
    "nethttp": ({"main.go": 'package main\nfunc main() {\n\tmux := http.NewServeMux()\n\tmux.HandleFunc("GET /n/{id}", h)\n}\nfunc h(w http.ResponseWriter, r *http.Request) { q := r.URL.Query().Get("q"); w.Write([]byte(q)) }\n'}, {("get", "/n/{id}")}, set()),
    "spring": ({
        "src/A.java": 'import org.springframework.web.bind.annotation.*;\n@RestController\n@RequestMapping("/api/users")\npublic class A implements Shared {\n  private final Svc svc;\n  @GetMapping("/{id}")\n  public ResponseEntity<User> one(@PathVariable Long id, @RequestParam(defaultValue = "1") int page, @RequestHeader("X-Key") String key) { return null; }\n  @PostMapping\n  @ResponseStatus(HttpStatus.CREATED)\n  public User make(@Valid @RequestBody User user) { return user; }\n  @Override\n  public String shared() { return ""; }\n}\n',
        "src/User.java": 'public class User {\n  @NotNull\n  private Long id;\n  @Size(min = 2, max = 9)\n  private String name;\n  private List<String> tags = new ArrayList<>();\n  public Long getId() { return id; }\n}\n',
        "src/Shared.java": 'public interface Shared {\n  @GetMapping("/shared")\n  String shared();\n}\n',
    }, {("get", "/api/users/{id}"), ("post", "/api/users"), ("get", "/api/users/shared")}, set()),
    "jaxrs": ({"R.java": '@Path("/r")\npublic class R {\n  @GET\n  @Path("{id: [0-9]+}")\n  public Dto one(@PathParam("id") int id, @QueryParam("q") String q) { return null; }\n  @DELETE\n  public void gone() {}\n}\nrecord Dto(int a, String b) {}\n'}, {("get", "/r/{id}"), ("delete", "/r")}, set()),
    "micronaut": ({"M.java": '@Controller("/m")\nclass M {\n  @Get("/{id}")\n  String one(Long id, @QueryValue String q) { return ""; }\n  @Post\n  HttpResponse<Dto> make(@Body Dto d) { return HttpResponse.created(d); }\n}\nclass Dto { String a; }\n'}, {("get", "/m/{id}"), ("post", "/m")}, set()),
    "aspnet": ({
        "C.cs": 'using Microsoft.AspNetCore.Mvc;\n[ApiController]\n[Route("api/[controller]")]\npublic class ItemsController : ControllerBase {\n  [HttpGet("{id:int}")]\n  public async Task<ActionResult<Item>> Get(int id, [FromQuery] string? q) { return null; }\n  [HttpPost]\n  public IActionResult Make([FromBody] Item item) => Ok();\n}\npublic class Item { public required string Name { get; set; } public int? Size { get; set; } }\n',
        "Program.cs": 'var app = WebApplication.CreateBuilder(args).Build();\nvar g = app.MapGroup("/g");\ng.MapGet("/x/{id}", (int id) => Results.Ok());\n',
    }, {("get", "/api/Items/{id}"), ("post", "/api/Items"), ("get", "/g/x/{id}")}, set()),
    "fastendpoints": ({"E.cs": 'public class E : Endpoint<Req, Res> {\n  public override void Configure() { Post("/fe/{id}"); AllowAnonymous(); }\n}\npublic class Req { public string A { get; set; } }\npublic class Res { public int B { get; set; } }\n'}, {("post", "/fe/{id}")}, set()),
    "axum": ({"m.rs": 'use axum::Router;\nfn app() -> Router { Router::new().route("/a/:id", get(h).post(h2)).nest("/n", sub()) }\nfn sub() -> Router { Router::new().route("/s", delete(h)) }\n'}, {("get", "/a/{id}"), ("post", "/a/{id}"), ("delete", "/n/s")}, set()),
    "actix": ({"m.rs": 'use actix_web::{get, web};\n#[get("/u/{id}")]\nasync fn user() {}\n#[post("/p")]\nasync fn free() {}\nfn cfg() { App::new().service(web::scope("/api").service(user)); }\n'}, {("get", "/api/u/{id}"), ("post", "/p")}, set()),
    "rocket": ({"m.rs": '#[get("/r/<id>?<q>")]\nfn r(id: usize, q: String) {}\n#[get("/lost")]\nfn lost() {}\nfn rocket() { rocket::build().mount("/b", routes![r]); }\n'}, {("get", "/b/r/{id}")}, {"unreachable-router"}),
    "laravel": ({
        "routes/api.php": "<?php\nuse Illuminate\\Support\\Facades\\Route;\nRoute::get('/users/{id?}', [UserController::class, 'show']);\nRoute::prefix('admin')->group(function () {\n  Route::apiResource('photos', PhotoController::class)->only(['index', 'store']);\n});\n",
        "app/UserController.php": "<?php\nclass UserController {\n  public function show(Request $r) { $r->validate(['page' => 'required|integer|max:9']); return response()->json([], 200); }\n}\n",
    }, {("get", "/api/users/{id}"), ("get", "/api/admin/photos"), ("post", "/api/admin/photos")}, set()),
    "symfony": ({"src/C.php": "<?php\n#[Route('/blog')]\nclass C {\n  #[Route('/{slug}', methods: ['GET', 'POST'])]\n  public function one() {}\n  #[Route('/plain')]\n  public function plain() {}\n}\n", "config/routes.yaml": "home:\n  path: /home/{p}\n  controller: App\\C::home\n"}, {("get", "/blog/{slug}"), ("post", "/blog/{slug}"), ("get", "/blog/plain"), ("get", "/home/{p}")}, set()),
    "slim": ({"public/routes.php": "<?php\n$app->group('/v1', function ($group) {\n  $group->get('/i/{id:[0-9]{1,3}}', H::class);\n});\n$app->map(['GET', 'PUT'], '/m', H::class);\n$app->options('/{routes:.+}', H::class);\n"}, {("get", "/v1/i/{id}"), ("get", "/m"), ("put", "/m")}, set()),
}


@pytest.mark.parametrize("framework", PROJECTS)
def test_routes_and_remarks(framework):
    files, routes, remarks = PROJECTS[framework]
    found = registry()[framework][1](files)
    assert {(r["method"], r["full_path"]) for r in found.routes} == routes
    assert {u["reason"] for u in found.unresolved} == remarks
    json.dumps([found.routes, found.components])


def test_every_pack_has_a_project():
    assert set(PROJECTS) == set(registry()) and len(PROJECTS) == 28


def by_key(framework):
    found = registry()[framework][1](PROJECTS[framework][0])
    return {(r["method"], r["full_path"]): r for r in found.routes}, found


def test_fastapi_contracts():
    routes, found = by_key("fastapi")
    one = routes["get", "/api/v1/things/{thing_id}"]
    assert [(p["name"], p["in"], p["required"]) for p in one["parameters"]] == [("thing_id", "path", True), ("query", "query", False)]
    assert one["security"] == [{"HTTPBearer": []}] and found.security["HTTPBearer"]["scheme"] == "bearer"
    assert [r["status_code"] for r in one["responses"]] == ["200", "404"]
    thing = found.components["Thing"]
    assert thing["required"] == ["title"] and thing["properties"]["title"]["minLength"] == 2 and thing["properties"]["price"]["type"] == ["number", "null"]
    make = routes["post", "/api/v1/things"]
    assert make["request_body"]["content"][0]["schema"] == {"$ref": "#/components/schemas/Thing"} and make["responses"][0]["status_code"] == "201"


def test_other_contracts():
    routes, _ = by_key("flask")
    assert [r["status_code"] for r in routes["post", "/x/{n}"]["responses"]] == ["201"] and [r["status_code"] for r in routes["get", "/x/{n}"]["responses"]] == ["200"]
    routes, found = by_key("express")
    item = routes["get", "/v1/items/{itemId}"]
    assert {(p["name"], p["in"]) for p in item["parameters"]} == {("itemId", "path"), ("page", "query")}
    assert list(item["responses"][0]["content"][0]["schema"]["properties"]) == ["id", "name"]
    assert routes["post", "/v1/items"]["responses"][0]["status_code"] == "201" and found.servers == ["http://localhost:4000"]
    routes, found = by_key("gin")
    assert routes["post", "/v1/items"]["responses"][0]["status_code"] == "201"
    assert found.components["Item"]["required"] == ["id"] and found.components["Item"]["properties"]["note"]["type"] == ["string", "null"]
    routes, found = by_key("spring")
    one = routes["get", "/api/users/{id}"]
    assert [(p["name"], p["in"], p["required"]) for p in one["parameters"]] == [("id", "path", True), ("page", "query", False), ("X-Key", "header", True)]
    assert routes["post", "/api/users"]["responses"][0]["status_code"] == "201" and found.components["User"]["required"] == ["id"] and found.components["User"]["properties"]["name"]["maxLength"] == 9
    routes, _ = by_key("laravel")
    assert ("page", "query", True) in {(p["name"], p["in"], p["required"]) for p in routes["get", "/api/users/{id}"]["parameters"]}
