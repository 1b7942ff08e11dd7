"""Queries for what works on source text and JSON values: packs, validators, ORM models, schemas, the gate, reviews.

Each nation is a project or a value of its own: sources are templates in which @w is the nation's name in lower case
without spaces and @k its key, and the case of a nation is chosen by its key. The SQL states the expected value of each
case and fills in the same names, so it does not share any code with the functions under test.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions import paths, schemas
from corvid.operators import closure, gate, merge, variants
from corvid.operators.dedupe import free_names
from corvid.packs import extract, registry, types, validators
from corvid.packs.routes import VERBS
from corvid.plans import openapi, review
from corvid.queries import query
from corvid.sources import models
from corvid.sources import scan as sources

_WORD = "lower(replace(n_name, ' ', ''))"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(text: str) -> str:
    return f"replace(replace({text}, '@w', {_WORD}), '@k', CAST(n_nationkey AS VARCHAR))"


def _named(text: Column) -> Column:
    word = F.lower(F.replace("n_name", F.lit(" "), F.lit("")))
    return F.replace(F.replace(text, F.lit("@w"), word), F.lit("@k"), F.col("n_nationkey").cast("string"))


def _case(values: Sequence[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.col("n_nationkey") % len(values)).cast("int"))


def value_query(name: str, function: Callable, cases: Sequence[tuple[str, object]]) -> None:
    """Register function(source text) over the nations; cases are (source, expected value), "@k#" being a number."""
    expected = [_literal(schemas.canonical(e).replace('"@k#"', "@k")) for _, e in cases]
    sql = "CASE " + " ".join(f"WHEN n_nationkey % {len(cases)} = {i} THEN {e}" for i, e in enumerate(expected)) + " END"

    def run(table) -> DataFrame:
        @F.pandas_udf("string")
        def convert(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: schemas.canonical(function(t)))

        return table("nation").select(F.col("n_nationkey").alias("key"), convert(_named(_case([s for s, _ in cases]))).alias("value"))

    query(f"SELECT n_nationkey AS key, {_filled(sql)} AS value FROM nation", name)(run)


def pack_query(framework: str, files: Mapping[str, str], rows: Sequence[tuple[str, str, str, str]]) -> None:
    """Register a framework's pack over the nations, each a project; rows are (method, path, parameters, statuses) and, for
    what is left unresolved, ("unresolved", reason, "", "")."""
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    sql = f"SELECT {_WORD} AS project, {_filled('method')} AS method, {_filled('path')} AS path, {_filled('parameters')} AS parameters, statuses FROM nation, (VALUES {values}) v(method, path, parameters, statuses)"

    def run(table) -> DataFrame:
        texts = _project_files(table, framework, files)
        found = extract(texts, texts.select("project", F.lit(framework).alias("framework")).distinct())
        route = F.from_json("value", "method string, full_path string, reason string, parameters array<struct<name string, `in` string>>, responses array<struct<status_code string>>")
        found = found.filter("kind IN ('route', 'unresolved')").select("project", "kind", route.alias("r"))
        listed = F.array_join(F.array_sort(F.transform("r.parameters", lambda p: F.concat(p["in"], F.lit(":"), p["name"]))), ",")
        statuses = F.array_join(F.array_sort(F.transform("r.responses", lambda p: p["status_code"])), ",")
        return found.select("project", F.coalesce("r.method", "kind").alias("method"), F.coalesce("r.full_path", "r.reason").alias("path"), F.coalesce(listed, F.lit("")).alias("parameters"), F.coalesce(statuses, F.lit("")).alias("statuses"))

    query(sql, f"pack_{framework}")(run)


def contract_query(framework: str, files: Mapping[str, str], rows: Sequence[tuple], about: str = "") -> None:
    """As pack_query, with what routes declare: rows are (method, path, parameters, body, statuses, result, security), body and
    result (of the first response) being schemas or None, parameters in:name:type."""
    text = lambda v: "" if v is None else schemas.canonical(v).replace('"@k#"', "@k")
    values = ", ".join("(" + ", ".join(map(_literal, (m, p, a, text(b), st, text(r), sec))) + ")" for m, p, a, b, st, r, sec in rows)
    names = "method, path, parameters, body, statuses, result, security"
    sql = f"SELECT {_WORD} AS project, method, {_filled('path')} AS path, {_filled('parameters')} AS parameters, {_filled('body')} AS body, statuses, {_filled('result')} AS result, security FROM nation, (VALUES {values}) v({names})"

    def run(table) -> DataFrame:
        @F.pandas_udf("string")
        def told(candidates: pd.Series) -> pd.Series:
            def one(c: dict) -> dict:
                kind = lambda p: "/".join([t] if isinstance(t := (p.get("schema") or {}).get("type", ""), str) else t)
                body, first = (c.get("request_body") or {}).get("content"), (c["responses"] or [{}])[0].get("content")
                shown = lambda content: schemas.canonical(content[0].get("schema")) if content and content[0].get("schema") is not None else ""
                return {
                    "method": c["method"], "path": c["full_path"], "parameters": ",".join(sorted(f"{p['in']}:{p['name']}:{kind(p)}" for p in c["parameters"])), "body": shown(body),
                    "statuses": ",".join(sorted(r["status_code"] for r in c["responses"])), "result": shown(first), "security": ",".join(sorted(k for s in c.get("security") or [] for k in s)),
                }

            return candidates.map(lambda t: json.dumps(one(json.loads(t))))

        texts = _project_files(table, framework, files)
        found = extract(texts, texts.select("project", F.lit(framework).alias("framework")).distinct()).filter("kind = 'route'")
        row = F.from_json(told("value"), ", ".join(f"{n} string" for n in names.split(", ")))
        return found.select("project", row.alias("r")).select("project", "r.*")

    query(sql, f"contract_{framework}{about}")(run)


def _project_files(table, framework: str, files: Mapping[str, str]) -> DataFrame:
    project = F.lower(F.replace("n_name", F.lit(" "), F.lit("")))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(t).alias("content")) for p, t in files.items())))
    texts = table("nation").select("n_name", "n_nationkey", project.alias("project"), each.alias("f")).select("project", _named(F.col("f.path")).alias("path"), _named(F.col("f.content")).alias("content"))
    return texts.withColumn("language", F.when(F.col("path").rlike(r"\.ya?ml$"), "yaml").when(F.col("path").endswith(".prisma"), "prisma").otherwise(F.lit(registry()[framework][0])))


# --- packs -----------------------------------------------------------------------------------------------------------

_ID = "path:id"
_PACKS: dict[str, tuple[dict[str, str], list[tuple[str, str, str, str]]]] = {
    "fastapi": ({
        "app/main.py": "from fastapi import FastAPI\nfrom .things import router as things\nfrom .lost import lonely\napp = FastAPI()\nBASE = '/@w'\napp.include_router(things, prefix=BASE + '/v@k')\n@app.get('/health')\ndef health(): return {'ok': True}\nclient.get('/decoy')\n",
        "app/things.py": "from fastapi import APIRouter\nrouter = APIRouter(prefix='/things')\n@router.get('/{thing_id}')\ndef one(thing_id: int, q: str = ''): return {'id': thing_id}\n@router.post('', status_code=201)\ndef make(): return {'id': 1}\n",
        "app/lost.py": "from fastapi import APIRouter\nlonely = APIRouter()\n@lonely.get('/never')\ndef never(): ...\n",
    }, [("get", "/@w/v@k/things/{thing_id}", "path:thing_id,query:q", "200"), ("post", "/@w/v@k/things", "", "201"), ("get", "/health", "", "200"), ("unresolved", "unreachable-router", "", "")]),
    "flask": ({"app.py": "from flask import Flask, Blueprint, jsonify, request\napp = Flask(__name__)\nbp = Blueprint('b', __name__, url_prefix='/@w')\napp.register_blueprint(bp)\n@app.route('/x/<int:id>', methods=['GET', 'DELETE'])\ndef x(id):\n    return {'n': 1}\n@bp.post('/y@k')\ndef y():\n    return jsonify(made=1), 201\n"},
        [("get", "/x/{id}", _ID, "200"), ("delete", "/x/{id}", _ID, "200"), ("post", "/@w/y@k", "", "201")]),
    "starlette": ({"a.py": "from starlette.applications import Starlette\nfrom starlette.routing import Route, Mount\nfrom starlette.responses import JSONResponse\nasync def home(request): return JSONResponse({'a': 1})\nsub = [Route('/in/{id:int}', home, methods=['POST'])]\napp = Starlette(routes=[Route('/@w', home), Mount('/m@k', routes=sub)])\n"},
        [("get", "/@w", "", "200"), ("post", "/m@k/in/{id}", _ID, "200")]),
    "djangorestframework": ({
        "proj/urls.py": "from django.urls import path, include\nurlpatterns = [path('@w/', include('shop.urls'))]\n",
        "shop/urls.py": "from django.urls import path\nfrom rest_framework.routers import DefaultRouter\nfrom .views import BookViewSet\nrouter = DefaultRouter()\nrouter.register('books@k', BookViewSet)\nurlpatterns = router.urls\n",
        "shop/views.py": "from rest_framework import viewsets, serializers\nclass BookSerializer(serializers.Serializer):\n    title = serializers.CharField()\nclass BookViewSet(viewsets.ReadOnlyModelViewSet):\n    serializer_class = BookSerializer\n",
    }, [("get", "/@w/books@k/", "", "200"), ("get", "/@w/books@k/{id}/", _ID, "200")]),
    "express": ({
        "src/app.js": "const express = require('express');\nconst items = require('./items');\nconst app = express();\napp.use('/@w', items); // app.get('/comment', x)\napp.get('/health', (req, res) => res.send('ok'));\naxios.get('/decoy');\n",
        "src/items.js": "const { Router } = require('express');\nconst router = Router();\nrouter.get('/v@k/:id', (req, res) => { const a = req.query.page; res.json({ id: 1 }); });\nrouter.route('/both').post(make).delete(make);\nfunction make(req, res) { res.status(201).json({ title: req.body.title }); }\nmodule.exports = router;\n",
        "src/lost.js": "const { Router } = require('express');\nconst lonely = Router();\nlonely.get('/never', (req, res) => res.end());\n",
    }, [("get", "/@w/v@k/{id}", "path:id,query:page", "200"), ("post", "/@w/both", "", "201"), ("delete", "/@w/both", "", "201"), ("get", "/health", "", "200"), ("unresolved", "unreachable-router", "", "")]),
    "koa": ({"a.js": "const Koa = require('koa'); const Router = require('@koa/router');\nconst app = new Koa();\nconst router = new Router({ prefix: '/@w' });\nrouter.get('/u@k/:id', ctx => { ctx.body = { id: 1 }; });\nrouter.put('/p', ctx => { ctx.status = 202; ctx.body = { ok: ctx.request.body.ok }; });\napp.use(router.routes());\n"},
        [("get", "/@w/u@k/{id}", _ID, "200"), ("put", "/@w/p", "", "202")]),
    "hono": ({"a.ts": "import { Hono } from 'hono'\nconst app = new Hono()\nconst sub = new Hono()\nsub.get('/s@k/:id', (c) => c.json({ a: 1 }, 201))\napp.route('/@w', sub)\napp.post('/p', (c) => c.text('x'))\n"},
        [("get", "/@w/s@k/{id}", _ID, "201"), ("post", "/p", "", "200")]),
    "elysia": ({"a.ts": "import { Elysia } from 'elysia'\nconst app = new Elysia({ prefix: '/@w' })\napp.get('/x@k/:id', () => 'hi')\n"}, [("get", "/@w/x@k/{id}", _ID, "")]),
    "fastify": ({"a.js": "const fastify = require('fastify')();\nasync function plug(instance, opts) { instance.get('/in', async (req, reply) => reply.send({ a: 1 })); }\nfastify.register(plug, { prefix: '/@w' });\nfastify.route({ method: ['GET', 'PUT'], url: '/r@k/:id', handler: (req, reply) => reply.code(201).send({ ok: true }) });\n"},
        [("get", "/@w/in", "", "200"), ("get", "/r@k/{id}", _ID, "201"), ("put", "/r@k/{id}", _ID, "201")]),
    "nest": ({"c.ts": "import { Controller, Get } from '@nestjs/common';\n@Controller('@w')\nexport class Cats {\n  @Get('c@k/:id')\n  one(@Param('id') id: string, @Query('full') full?: string) { return { id: 1 }; }\n  @Post()\n  async make(@Body() dto: X) { return {}; }\n}\n", "main.ts": "app.setGlobalPrefix('api');"},
        [("get", "/api/@w/c@k/{id}", "path:id,query:full", "200"), ("post", "/api/@w", "", "201")]),
    "nextjs": ({"app/api/@w/[id]/route.ts": "export async function GET(req) { return Response.json({ a: 1 }) }\nexport const DELETE = async () => new Response(null)", "pages/api/v@k.ts": "export default function h(req, res) { res.status(202).json({}) }", "app/(shop)/api/all/[...rest]/route.ts": "export async function POST() { return Response.json({ b: 1 }, { status: 201 }) }"},
        [("get", "/api/@w/{id}", _ID, "200"), ("delete", "/api/@w/{id}", _ID, ""), ("get", "/api/v@k", "", "202"), ("post", "/api/all/{rest}", "path:rest", "201")]),
    "gin": ({"main.go": 'package main\nimport "github.com/gin-gonic/gin"\nfunc main() {\n\tr := gin.Default()\n\tv1 := r.Group("/@w")\n\tv1.GET("/i@k/:id", one)\n\tv1.Any("/any", none)\n\tregister(v1)\n\thttp.Get("/decoy")\n}\nfunc register(rg *gin.RouterGroup) {\n\trg.POST("/items", one)\n}\nfunc one(c *gin.Context) {\n\tq := c.Query("page")\n\tc.JSON(http.StatusAccepted, gin.H{"q": q})\n}\nfunc none(c *gin.Context) { c.Status(http.StatusNoContent) }\n'},
        [("get", "/@w/i@k/{id}", "path:id,query:page", "202"), ("post", "/@w/items", "query:page", "202"), *((v, "/@w/any", "", "204") for v in VERBS)]),
    "echo": ({"main.go": 'package main\nfunc main() {\n\te := echo.New()\n\tg := e.Group("/@w")\n\tg.PUT("/a@k/:id", h)\n}\nfunc h(c echo.Context) error { return c.NoContent(http.StatusNoContent) }\n'}, [("put", "/@w/a@k/{id}", _ID, "204")]),
    "fiber": ({"main.go": 'package main\nfunc main() {\n\tapp := fiber.New()\n\tapp.Get("/@w/f@k/:id", func(c *fiber.Ctx) error { return c.Status(202).JSON(fiber.Map{"a": 1}) })\n}\n'}, [("get", "/@w/f@k/{id}", _ID, "202")]),
    "chi": ({"main.go": 'package main\nfunc main() {\n\tr := chi.NewRouter()\n\tr.Route("/@w", func(r chi.Router) {\n\t\tr.Get("/", list)\n\t\tr.Route("/{id:[0-9]+}", func(r chi.Router) {\n\t\t\tr.Delete("/d@k", list)\n\t\t})\n\t})\n\tr.Mount("/admin", adminRouter())\n}\nfunc adminRouter() http.Handler {\n\tr := chi.NewRouter()\n\tr.Get("/stats", list)\n\treturn r\n}\nfunc list(w http.ResponseWriter, r *http.Request) { w.WriteHeader(http.StatusCreated) }\n'},
        [("get", "/@w", "", "201"), ("delete", "/@w/{id}/d@k", _ID, "201"), ("get", "/admin/stats", "", "201")]),
    "gorillamux": ({"main.go": 'package main\nfunc main() {\n\tr := mux.NewRouter()\n\ts := r.PathPrefix("/@w").Subrouter()\n\ts.HandleFunc("/b@k/{id:[a-z]+}", h).Methods("GET", "POST")\n}\nfunc h(w http.ResponseWriter, r *http.Request) { json.NewEncoder(w).Encode(map[string]any{"a": 1}) }\n'},
        [("get", "/@w/b@k/{id}", _ID, "200"), ("post", "/@w/b@k/{id}", _ID, "200")]),
    "nethttp": ({"main.go": 'package main\nfunc main() {\n\tmux := http.NewServeMux()\n\tmux.HandleFunc("GET /@w/n@k/{id}", h)\n}\nfunc h(w http.ResponseWriter, r *http.Request) { q := r.URL.Query().Get("q"); w.Write([]byte(q)) }\n'}, [("get", "/@w/n@k/{id}", "path:id,query:q", "200")]),
    "spring": ({
        "src/A.java": 'import org.springframework.web.bind.annotation.*;\n@RestController\n@RequestMapping("/@w")\npublic class A implements Shared {\n  @GetMapping("/u@k/{id}")\n  public User one(@PathVariable Long id, @RequestParam(defaultValue = "1") int page) { return null; }\n  @PostMapping\n  @ResponseStatus(HttpStatus.CREATED)\n  public User make(@RequestBody User u) { return u; }\n  public String shared() { return null; }\n}\n',
        "src/User.java": "public class User {\n  private Long id;\n}\n", "src/Shared.java": 'public interface Shared {\n  @GetMapping("/shared")\n  String shared();\n}\n',
    }, [("get", "/@w/u@k/{id}", "path:id,query:page", "200"), ("post", "/@w", "", "201"), ("get", "/@w/shared", "", "200")]),
    "jaxrs": ({"R.java": '@Path("/@w")\npublic class R {\n  @GET\n  @Path("r@k/{id: [0-9]+}")\n  public Dto one(@PathParam("id") int id, @QueryParam("q") String q) { return null; }\n  @DELETE\n  public void gone() {}\n}\nrecord Dto(int a, String b) {}\n'},
        [("get", "/@w/r@k/{id}", "path:id,query:q", "200"), ("delete", "/@w", "", "204")]),
    "micronaut": ({"M.java": '@Controller("/@w")\nclass M {\n  @Get("/m@k/{id}")\n  String one(Long id, @QueryValue String q) { return ""; }\n  @Post\n  HttpResponse<Dto> make(@Body Dto d) { return HttpResponse.created(d); }\n}\nclass Dto { String a; }\n'},
        [("get", "/@w/m@k/{id}", "path:id,query:q", "200"), ("post", "/@w", "", "201")]),
    "aspnet": ({
        "C.cs": 'using Microsoft.AspNetCore.Mvc;\n[ApiController]\n[Route("api/[controller]")]\npublic class ItemsController : ControllerBase {\n  [HttpGet("{id:int}")]\n  public ActionResult<Item> Get(int id, [FromQuery] string? q) { return null; }\n}\npublic class Item { public required string Name { get; set; } }\n',
        "Program.cs": 'var app = WebApplication.CreateBuilder(args).Build();\nvar g = app.MapGroup("/@w");\ng.MapGet("/x@k/{id}", (int id) => Results.Ok());\n',
    }, [("get", "/api/Items/{id}", "path:id,query:q", "200"), ("get", "/@w/x@k/{id}", _ID, "200")]),
    "fastendpoints": ({"E.cs": 'public class E : Endpoint<Req, Res> {\n  public override void Configure() { Verbs(Http.POST, Http.PUT); Routes("/@w/fe@k/{id}", "/other@k"); AllowAnonymous(); }\n}\npublic class Req { public string A { get; set; } }\npublic class Res { public int B { get; set; } }\n'}, [(v, p, q, "200") for v in ("post", "put") for p, q in (("/@w/fe@k/{id}", _ID), ("/other@k", ""))]),
    "axum": ({"m.rs": 'use axum::Router;\nfn app() -> Router { Router::new().route("/a@k/:id", get(h).post(h2)).nest("/@w", sub()) }\nfn sub() -> Router { Router::new().route("/s", delete(h)) }\n'}, [("get", "/a@k/{id}", _ID, ""), ("post", "/a@k/{id}", _ID, ""), ("delete", "/@w/s", "", "")]),
    "actix": ({"m.rs": 'use actix_web::{get, web};\n#[get("/u@k/{id}")]\nasync fn user() {}\n#[post("/p")]\nasync fn free() {}\nfn cfg() { App::new().service(web::scope("/@w").service(user)); }\n'}, [("get", "/@w/u@k/{id}", _ID, ""), ("post", "/p", "", "")]),
    "rocket": ({"m.rs": '#[get("/r@k/<id>?<q>")]\nfn r(id: usize, q: String) {}\n#[get("/lost")]\nfn lost() {}\nfn rocket() { rocket::build().mount("/@w", routes![r]); }\n'}, [("get", "/@w/r@k/{id}", "path:id,query:q", ""), ("unresolved", "unreachable-router", "", "")]),
    "laravel": ({
        "routes/api.php": "<?php\nuse Illuminate\\Support\\Facades\\Route;\nRoute::get('/users/{id?}', [UserController::class, 'show']);\nRoute::prefix('@w')->group(function () {\n  Route::apiResource('photos.tags', TagController::class)->only(['index', 'update']);\n});\n",
        "app/UserController.php": "<?php\nclass UserController {\n  public function show(Request $r) { return response()->json([], 202); }\n}\n",
    }, [("get", "/api/users/{id}", _ID, "202"), ("get", "/api/@w/photos/{photo}/tags", "path:photo", "200"), ("put", "/api/@w/photos/{photo}/tags/{tag}", "path:photo,path:tag", "200"), ("patch", "/api/@w/photos/{photo}/tags/{tag}", "path:photo,path:tag", "200")]),
    "symfony": ({"src/C.php": "<?php\n#[Route('/@w')]\nclass C {\n  #[Route('/{slug}', methods: ['GET', 'POST'])]\n  public function one() {}\n  #[Route('/v@k')]\n  public function plain() {}\n}\n", "config/routes.yaml": "home:\n  path: /home/{p}\n  controller: App\\C::home\n"},
        [("get", "/@w/{slug}", "path:slug", ""), ("post", "/@w/{slug}", "path:slug", ""), ("get", "/@w/v@k", "", ""), ("get", "/home/{p}", "path:p", "")]),
    "slim": ({"public/routes.php": "<?php\n$app->group('/@w', function ($group) {\n  $group->get('/i@k/{id:[0-9]{1,3}}', H::class);\n});\n$app->map(['GET', 'PUT'], '/m', H::class);\n"}, [("get", "/@w/i@k/{id}", _ID, ""), ("get", "/m", "", ""), ("put", "/m", "", "")]),
}

for _framework, (_sources, _rows) in _PACKS.items():
    pack_query(_framework, _sources, _rows)


# --- validators and models -------------------------------------------------------------------------------------------


def _object(required: Sequence[str] = (), **properties) -> dict:
    return {"type": "object", "properties": {("@w" if k == "w" else k): v for k, v in properties.items()}, **({"required": list(required)} if required else {})}


_S, _I, _N, _B = ({"type": t} for t in ("string", "integer", "number", "boolean"))
value_query("validator_zod", validators.zod, [
    ("z.object({ @w: z.string().min(@k).max(99), zz: z.number().int().optional() })", _object(["@w"], w={**_S, "minLength": "@k#", "maxLength": 99}, zz=_I)),
    ("z.array(z.enum(['@w', 'zz'])).min(@k)", {"type": "array", "items": {**_S, "enum": ["@w", "zz"]}, "minItems": "@k#"}),
    ("z.union([z.string().email(), z.literal('@w')]).nullable()", {"anyOf": [{"anyOf": [{**_S, "format": "email"}, {**_S, "const": "@w"}]}, {"type": "null"}]}),
])
value_query("validator_joi", validators.joi, [
    ("Joi.object({ @w: Joi.string().required(), zz: Joi.number().integer().min(@k) })", _object(["@w"], w=_S, zz={**_I, "minimum": "@k#"})),
    ("Joi.string().valid('@w', 'zz')", {**_S, "enum": ["@w", "zz"]}),
])
value_query("validator_yup", validators.yup, [
    ("yup.object({ @w: yup.string().email().required(), zz: yup.array().of(yup.number()) })", _object(["@w"], w={**_S, "format": "email"}, zz={"type": "array", "items": _N})),
    ("yup.number().max(@k).nullable()", {"type": ["number", "null"], "maximum": "@k#"}),
])
value_query("validator_typebox", validators.typebox, [("Type.Object({ @w: Type.String({ minLength: @k }), zz: Type.Optional(Type.Integer()) })", _object(["@w"], w={**_S, "minLength": "@k#"}, zz=_I))])
value_query("validator_arktype", validators.arktype, [
    ("string.email | null", {"type": ["string", "null"], "format": "email"}), ("number >= @k", {**_N, "minimum": "@k#"}), ("'@w' | 'zz'", {**_S, "enum": ["@w", "zz"]}), ("1 < string <= @k", {**_S, "exclusiveMinimum": 1, "maxLength": "@k#"}),
])
value_query("validator_fluent_schema", validators.fluent, [("S.object().prop('@w', S.string().required()).prop('zz', S.integer())", _object(["@w"], w=_S, zz=_I))])
value_query("validator_express_validator", lambda t: list(validators.express_validator(t)), [
    ("body('@w').isInt({ min: 1, max: @k }).optional()", ["body", "@w", {**_I, "minimum": 1, "maximum": "@k#"}, False]), ("query('@w').isEmail()", ["query", "@w", {**_S, "format": "email"}, True]),
])
value_query("validator_fluent_validation", lambda t: validators.fluent_validation(t, _object(zz=_S)), [("RuleFor(x => x.Zz).NotEmpty().MaximumLength(@k); RuleFor(x => x.Zzz).GreaterThan(@k);", _object(["zz"], zz={**_S, "maxLength": "@k#"}, zzz={"exclusiveMinimum": "@k#"}))])
value_query("validator_marshmallow", validators.marshmallow, [("class A(Schema):\n    a = fields.Str(required=True, data_key='@w')\n    zz = fields.Nested(BSchema, many=True)\n    zzz = fields.Int(dump_only=True)\n", _object(["@w"], w=_S, zz={"type": "array", "items": {"$ref": "#/components/schemas/B"}}, zzz={**_I, "readOnly": True}))])

_PRISMA = "model User {\n  id Int @id\n  zname String?\n  zposts Post[]\n}\nmodel Post {\n  id Int @id\n  zauthor User? @relation(fields: [x])\n  ztitle String\n}\n"
_POST, _USER = models.of_object({"id": _I, "ztitle": _S}), models.of_object({"id": _I, "zname": {"type": ["string", "null"]}})
value_query("orm_prisma", lambda t: models.prisma_result(models.prisma(_PRISMA), t), [
    ("prisma.user.findMany({ where: { zname: '@w' }, select: { id: true, zname: false, zposts: { select: { ztitle: true } } } })", {"type": "array", "items": models.of_object({"id": _I, "zposts": {"type": "array", "items": models.of_object({"ztitle": _S})}})}),
    ("prisma.user.count({ take: @k })", _I), ("prisma.post.findFirstOrThrow({ include: { zauthor: true } })", models.of_object({**_POST["properties"], "zauthor": models.nullable(_USER)})), ("prisma.user.deleteMany({ where: { id: @k } })", models.of_object({"count": _I})),
])
value_query("orm_sequelize", lambda t: models.sequelize_result(models.sequelize("const User = sequelize.define('User', { zname: { type: DataTypes.STRING, allowNull: false }, age: DataTypes.INTEGER });"), t), [
    ("User.findAll({ attributes: ['zname', ['age', '@w']] })", {"type": "array", "items": models.of_object({"zname": _S, "@w": {"type": ["integer", "null"]}})}),
])


# --- schemas ---------------------------------------------------------------------------------------------------------


def _json(function: Callable) -> Callable[[str], object]:
    return lambda text: function(json.loads(text))


value_query("schema_fill", _json(lambda v: schemas.filled(*v)), [
    ('[{"type": "string"}, {"type": "integer", "minimum": @k}]', _S), ('[{}, {"const": "@w"}]', {"const": "@w"}),
    ('[{"type": "object", "properties": {"@w": {}, "zz": {"type": "string"}}}, {"type": "object", "properties": {"@w": {"maximum": @k}, "zz": {"type": "number"}, "zzz": {"type": "null"}}}]', {"type": "object", "properties": {"@w": {"maximum": "@k#"}, "zz": _S}}),
    ('[{"type": "array"}, {"type": "array", "items": {"const": "@w"}, "minItems": 2}]', {"type": "array", "items": {"const": "@w"}}), ('[{"anyOf": [{"type": "array"}]}, {"type": "array", "items": {"$ref": "#/components/schemas/@w"}}]', {"type": "array", "items": {"$ref": "#/components/schemas/@w"}}),
])
value_query("schema_unknown", _json(schemas.has_unknown), [
    ('{"type": "object", "properties": {"@w": {}}}', True), ('{"type": "array", "maxItems": 0}', False), ('{"title": "@w"}', True), ('{"const": @k}', False), ('{"anyOf": [{"type": "string"}, {"type": "array"}]}', True),
])
value_query("schema_canonical", _json(schemas.canonical), [('{"zz": {"b": 1, "a": "@w"}, "@w": [@k]}', '{"@w":[@k],"zz":{"a":"@w","b":1}}')])
value_query("schema_references", _json(lambda v: sorted(schemas.closure(v, {"@": 0, "A": {"$ref": "#/components/schemas/B"}, "B": {"items": {"$ref": "#/components/schemas/A"}}}))), [
    ('{"properties": {"@w": {"$ref": "#/components/schemas/A"}}}', ["A", "B"]), ('{"$ref": "#/components/schemas/@w~1x"}', ["@w/x"]), ('{"type": "@w"}', []),
])
value_query("schema_namespaced", _json(lambda v: schemas.namespaced(v, "p_")), [('{"@w": {"$ref": "#/components/schemas/@w"}, "zz": {"$ref": "#/components/schemas/other"}}', {"p_@w": {"$ref": "#/components/schemas/p_@w"}, "p_zz": {"$ref": "#/components/schemas/other"}})])
value_query("schema_partial", _json(lambda v: schemas.partial(v, ["known", "more"])), [('{"type": "string", "x-discovery-incomplete": ["@w", "known"]}', {"type": "string", "x-discovery-incomplete": ["@w", "known", "more"]}), ('{"const": @k}', {"const": "@k#", "x-discovery-incomplete": ["known", "more"]})])
value_query("schema_clamped", _json(lambda v: schemas.clamped(v, ["Known"])), [
    ('{"type": "@w", "minimum": @k, "x": 1}', {"minimum": "@k#"}), ('{"type": "object", "properties": {"@w": {"type": "string", "bad": 1}, "__proto__": {}, "zz": {"$ref": "#/components/schemas/Other"}}, "required": ["@w", "gone"]}', _object(["@w"], w=_S, zz={})),
    ('{"anyOf": [{"$ref": "#/components/schemas/Known"}, {"$ref": "#/components/schemas/@w"}]}', {"anyOf": [{"$ref": "#/components/schemas/Known"}]}),
])


def _hoisted(value) -> list:
    components = {"Taken": {"type": "null"}}
    return [schemas.hoisted(value, components), sorted(components.items(), key=lambda x: (x[0] not in ("Taken", "Taken_2"), x))]


value_query("schema_hoisted", _json(_hoisted), [
    ('{"$defs": {"@w": {"$ref": "#/$defs/zz"}, "zz": {"type": "string"}}, "items": {"$ref": "#/$defs/@w"}}', [{"items": {"$ref": "#/components/schemas/@w"}}, [["Taken", {"type": "null"}], ["@w", {"$ref": "#/components/schemas/zz"}], ["zz", _S]]]),
    ('{"definitions": {"Taken": {"const": "@w"}}, "$ref": "#/definitions/Taken"}', [{"$ref": "#/components/schemas/Taken_2"}, [["Taken", {"type": "null"}], ["Taken_2", {"const": "@w"}]]]),
])
value_query("schema_of_literal", _json(schemas.of_literal), [('{"@w": [@k, "x"], "zz": {"b": true, "c": null}}', _object(["@w", "zz"], w={"type": "array", "items": _I}, zz=_object(["b", "c"], b=_B, c={"type": "null"}))), ('[1.5, "@w"]', {"type": "array", "items": _N})])
value_query("schema_leaves", _json(schemas.leaves), [('{"@w": [@k, {"b": 2}], "zz": {}}', {"/@w/0": "@k#", "/@w/1/b": 2, "/zz": {}})])
value_query("schema_hazards", _json(schemas.without_hazards), [('{"properties": {"constructor": {}, "@w": {"const": @k}}, "required": ["__proto__", "@w"]}', {"properties": {"@w": {"const": "@k#"}}, "required": ["@w"]})])


@query("""SELECT n_nationkey AS key, sha256(n_name || chr(0) || '{"components":{},"contract":{"a":"' || n_name || '","z":' || n_nationkey || '}}') AS print FROM nation""")
def route_fingerprint(table) -> DataFrame:
    """A route's fingerprint doesn't depend on the order of its keys, nor on its origin."""

    @F.pandas_udf("string")
    def prints(names: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([schemas.fingerprint(n, {"z": int(k), "origin": {"line": int(k)}, "a": n}, {}) for n, k in zip(names, keys)])

    return table("nation").select(F.col("n_nationkey").alias("key"), prints("n_name", "n_nationkey").alias("print"))


# --- responses, gate, names ------------------------------------------------------------------------------------------


def _answer(status: str, schema, media: str = "application/json") -> dict:
    return {"status_code": status, "description": "", "confidence": "high", "content": [{"media_type": media, "schema": schema}]}


value_query("responses_by_status", _json(variants.union_by_status), [
    (json.dumps([_answer("200", {"const": "@w"}), _answer("200", {"const": "zz"}), _answer("404", {"const": "no"})]), [_answer("200", {"anyOf": [{"const": "@w"}, {"const": "zz"}]}), _answer("404", {"const": "no"})]),
    (json.dumps([_answer("20@k", _S), _answer("20@k", _S)]), [_answer("20@k", _S)]),
    (json.dumps([_answer("200", _S), {**_answer("200", _S, "text/@w"), "confidence": "low"}]), [{**_answer("200", _S), "confidence": "low", "content": [{"media_type": "application/json", "schema": _S}, {"media_type": "text/@w", "schema": _S}]}]),
])


def _gate(value) -> list:
    out = gate.gated({"full_path": "/x/{id}", "parameters": [], "confidence": "high", **value})
    return [out["confidence"], out["gaps"], [[p["name"], p["confidence"]] for p in out["parameters"]]]


_LOW_ID = [["id", "low"]]
value_query("completeness_gate", _json(_gate), [
    (json.dumps({"responses": [_answer("200", {"const": "@w"})]}), ["high", [], _LOW_ID]), (json.dumps({"responses": []}), ["low", ["response-unknown"], _LOW_ID]),
    (json.dumps({"responses": [_answer("200", {"type": "array", "title": "@w"})]}), ["medium", ["response-schema-unknown"], _LOW_ID]), (json.dumps({"responses": [_answer("204", {})], "gaps": ["response-schema-unknown"]}), ["high", [], _LOW_ID]),
    (json.dumps({"responses": [_answer("200", _S)], "request_body": {"content": [{"media_type": "x/@w", "schema": {}}]}}), ["medium", ["body-schema-unknown"], _LOW_ID]),
])
value_query("free_names", _json(free_names), [
    ('["@w", "@w", "@w_2", "zz", "@w"]', ["@w", "@w_3", "@w_2", "zz", "@w_4"]), ('["a@k", "b", "a@k"]', ["a@k", "b", "a@k_2"]),
])


# --- paths, ignore rules, reviews, documents -------------------------------------------------------------------------

value_query("path_balanced", paths.balanced_template, [
    ("/@w/{id:[0-9]{1,3}}/x", "/@w/{id}/x"), ("v@k/{a:{b}}/{c}", "/v@k/{a}/{c}"), ("/@w/{open:[", "/@w/{open:["), (r"/{a:\{@k\}}/@w", "/{a}/@w"),
])
value_query("ignore_rules", _json(lambda v: [sources.ignored(p, [tuple(r) for r in v[1]]) for p in v[0]]), [
    ('[["@w/a.ts", "src/@w/b.ts", "src/c.ts"], [["", "@w/"]]]', [True, True, False]), ('[["a/@w.log", "a/keep.log"], [["", "*.log"], ["a", "!keep.log"]]]', [True, False]),
    ('[["v@k/x.ts", "src/v@k/x.ts"], [["", "/v@k"]]]', [True, False]), ('[["d/e/f/@w.ts", "d/@w.ts"], [["d", "**/f/*.ts"]]]', [True, False]),
])
value_query("handler_spans", _json(lambda v: review.spans([tuple(x) for x in v], 100)), [("[[1, 0, 10], [0, 5, 8]]", [[0, 5], [5, 8], [8, 10]]), ("[[0, 0, 100], [1, 200, 300]]", [[0, 100]])])
value_query("review_answer", review.parsed, [("```json\n{\"a\": \"@w\"}\n```", {"a": "@w"}), ('{"k": @k}', {"k": "@k#"}), ("no @w", None)])
value_query("component_context", _json(lambda v: list(review.component_context(v[0], v[1]))), [('[{"$ref": "#/components/schemas/A"}, {"A": {"$ref": "#/components/schemas/@w"}, "@w": {"const": @k}, "C": {}}]', ["A", "@w"])])


@query("SELECT n_nationkey AS key, substr(sha256('get /' || n_name || chr(0) || 'a' || chr(0) || 'b' || chr(0) || n_regionkey), 1, 16) AS id FROM nation")
def review_ids(table) -> DataFrame:
    @F.pandas_udf("string")
    def ids(names: pd.Series, regions: pd.Series) -> pd.Series:
        return pd.Series([review.review_id(f"get /{n}", ["b", "a"], str(r)) for n, r in zip(names, regions)])

    return table("nation").select(F.col("n_nationkey").alias("key"), ids("n_name", "n_regionkey").alias("id"))


def _merged(value) -> list:
    document, scanned, changes = value
    out, _ = merge.merge_document(document, scanned, [tuple(c) for c in changes])
    return [out["paths"], out["components"]["schemas"]]


value_query("document_merge", _json(_merged), [
    (json.dumps([{"paths": {"/@w": {"get": {"summary": "mine", "responses": {}}}}, "components": {"schemas": {"A": {"const": "mine"}}}},
                 {"paths": {"/@w": {"get": {"summary": "new", "responses": {"20@k": {"$ref": "#/components/schemas/A"}}}}}, "components": {"schemas": {"A": {"const": "@w"}}}}, [["changed", "get", "/@w"]]]),
     [{"/@w": {"get": {"summary": "mine", "responses": {"20@k": {"$ref": "#/components/schemas/A2"}}}}}, {"A": {"const": "mine"}, "A2": {"const": "@w"}}]),
])


value_query("openapi_problems", _json(openapi.problems), [
    ('{"openapi": "3.2.0", "info": {"title": "@w", "version": "1"}, "paths": {"/@w/{id}": {"get": {"parameters": [{"name": "id", "in": "path", "required": true, "schema": {"type": "string"}}], "responses": {"200": {"description": ""}}}}}}', []),
    ('{"openapi": "3.2.0", "info": {"title": "t", "version": "@k"}, "paths": {"/a/{@w}": {"get": {"responses": {"9@k": {"description": ""}}}}}, "components": {"schemas": {"A": {"$ref": "#/components/schemas/@w"}, "B": {"type": "@w"}}}}',
     [["components/schemas/A", "#/components/schemas/@w isn't there"], ["components/schemas/B", "unknown type @w"], ["get /a/{@w}", "path parameter @w isn't declared"], ["get /a/{@w}/responses/9@k", "unknown status"]]),
    ('{"openapi": "2.0", "info": {"title": "@w"}, "paths": {"@w": {"post": {"operationId": "x", "responses": {"200": {}}}}, "/y": {"get": {"operationId": "x", "responses": {"200": {"description": "z"}}}}}}',
     [["get /y", "operationId x is that of post @w"], ["info/version", "not a string"], ["@w", "a path begins with a slash"], ["openapi", "not a version 3"], ["post @w/responses/200", "no description"]]),
])


# --- contracts -------------------------------------------------------------------------------------------------------

contract_query("express", {"a.js": """const express = require('express');
const { z } = require('zod');
const app = express();
const router = express.Router();
const Thing = z.object({ @w: z.string().min(@k), zz: z.number().int().optional() });
app.use('/v1', router);
router.post('/zod', (req, res) => { const t = Thing.parse(req.body); res.status(201).json({ id: 1 }); });
router.post('/joi', validate({ body: Joi.object({ @w: Joi.string().required() }), query: Joi.object({ page: Joi.number().integer() }) }), (req, res) => res.json({ ok: true }));
router.post('/chain', [body('@w').isEmail(), query('size').isInt({ max: @k }).optional()], (req, res) => res.sendStatus(204));
router.get('/open', (req, res) => res.send('x'));
router.use(requireAuth);
router.get('/me', (req, res, next) => { if (!req.user) return next(new Error('no')); res.json({ id: 1 }); });
router.get('/token', passport.authenticate('jwt', { session: false }), (req, res) => res.json({ id: 1 }));
router.use((err, req, res, next) => { res.status(418).json({ error: 'x' }); });
"""}, [
    ("post", "/v1/zod", "", _object(["@w"], w={**_S, "minLength": "@k#"}, zz=_I), "201", _object(["id"], id=_I), ""),
    ("post", "/v1/joi", "query:page:integer", _object(["@w"], w=_S), "200", _object(["ok"], ok=_B), ""),
    ("post", "/v1/chain", "query:size:integer", _object(["@w"], w={**_S, "format": "email"}), "204", None, ""),
    ("get", "/v1/open", "", None, "200", _S, ""),
    ("get", "/v1/me", "", None, "200,418", _object(["id"], id=_I), "bearerAuth"),
    ("get", "/v1/token", "", None, "200", _object(["id"], id=_I), "bearerAuth"),
])
contract_query("express", {"prisma/schema.prisma": "model Thing {\n  zid Int @id\n  @w String?\n}\n", "m.js": "const s = new Schema({ @w: Number }, { versionKey: false });\nconst Row = mongoose.model('Row', s);\n", "a.js": """const express = require('express');
const app = express();
const prisma = new PrismaClient();
app.get('/all@k', async (req, res) => { const [all, total] = await Promise.all([prisma.thing.findMany(), prisma.thing.count()]); res.json({ all, total }); });
app.get('/one', async (req, res) => { const t = await prisma.thing.findFirst({ select: { @w: true } }); if (!t) throw new Error('x'); res.json(t); });
app.post('/rows', async (req, res) => { const row = await Row.create(req.body); res.status(201).json({ @w: row.@w, zid: row._id }); });
app.get('/rows', async (req, res) => { const rows = await Row.find().select('@w -_id').lean(); res.json(rows); });
app.get('/lost', async (req, res) => { res.json(await cache.thing.count()); });
"""}, [
    ("get", "/all@k", "", None, "200", _object(["all", "total"], all={"type": "array", "items": _object(["zid", "@w"], zid=_I, w={"type": ["string", "null"]})}, total=_I), ""),
    ("get", "/one", "", None, "200", _object(["@w"], w={"type": ["string", "null"]}), ""),
    ("post", "/rows", "", {}, "201", _object(["@w", "zid"], w=_N, zid=_S), ""),
    ("get", "/rows", "", None, "200", {"type": "array", "items": _object(["@w"], w=_N)}, ""),
    ("get", "/lost", "", None, "200", {}, ""),
], "_rows")
contract_query("fastify", {"m.js": "const User = sequelize.define('User', { @w: { type: DataTypes.STRING, allowNull: false }, zz: DataTypes.DATEONLY });\n", "a.js": "const fastify = require('fastify')();\nfastify.get('/@w', async (req, reply) => { const { rows, count } = await User.findAndCountAll({ attributes: ['@w', ['zz', 'zday']] }); return { rows, n: count }; });\n"},
               [("get", "/@w", "", None, "200", _object(["rows", "n"], rows={"type": "array", "items": _object(["@w", "zday"], w=_S, zday={"type": ["string", "null"], "format": "date"})}, n=_I), "")])
contract_query("starlette", {"a.py": "from starlette.applications import Starlette\nfrom starlette.routing import Route\nfrom starlette.exceptions import HTTPException\nfrom starlette.responses import JSONResponse\nclass Base(Exception): ...\nclass Lost(Base): ...\nasync def none(request, exc): return JSONResponse({'@w': 1}, status_code=exc.status_code)\nasync def lost(request, exc): return JSONResponse({'zz': 'x'}, status_code=410)\nasync def a(request): raise HTTPException(404)\nasync def b(request): raise Lost()\nasync def c(request): raise HTTPException(409)\napp = Starlette(routes=[Route('/@w/a', a), Route('/b@k', b), Route('/c', c)], exception_handlers={404: none, Base: lost})\n"}, [
    ("get", "/@w/a", "", None, "404", _object(["@w"], w=_I), ""), ("get", "/b@k", "", None, "410", _object(["zz"], zz=_S), ""), ("get", "/c", "", None, "409", _S, ""),
])
contract_query("flask", {"app.py": "from flask import Flask, jsonify, request, abort\nfrom marshmallow import Schema, fields\napp = Flask(__name__)\nclass Base(Schema):\n    @w = fields.Int(required=True)\nclass ThingSchema(Base):\n    zz = fields.Str()\nthings = ThingSchema(many=True)\n@app.errorhandler(404)\ndef none(e): return jsonify(zz='no'), 404\n@app.post('/@w')\ndef make():\n    data = ThingSchema().load(request.get_json())\n    return ThingSchema().dump(data), 201\n@app.get('/all@k')\ndef all():\n    args = Base().load(request.args)\n    return jsonify(things.dump([]))\n@app.get('/lost')\ndef lost():\n    abort(404)\n"}, [
    ("post", "/@w", "", {"$ref": "#/components/schemas/Thing"}, "201", {"$ref": "#/components/schemas/Thing"}, ""),
    ("get", "/all@k", "query:@w:integer", None, "200", {"type": "array", "items": {"$ref": "#/components/schemas/Thing"}}, ""),
    ("get", "/lost", "", None, "404", _object(["zz"], zz=_S), ""),
])
contract_query("express", {"types.ts": "import { type } from 'arktype';\nexport const Thing = type({ @w: 'string.email', 'zz?': 'number >= @k', zin: { a: \"'x' | 'y'\" } });\n", "a.ts": """import { type } from 'arktype';
import { Thing } from './types';
const app = express();
const Page = type({ 'page?': 'number.integer' });
app.post('/@w', (req, res) => { const t = Thing(req.body); const p = Page(req.query); if (t instanceof type.errors) return res.sendStatus(422); res.status(201).json({ id: 1 }); });
"""}, [("post", "/@w", "query:page:integer", _object(["@w", "zin"], w={**_S, "format": "email"}, zin=_object(["a"], a={**_S, "enum": ["x", "y"]}), zz={**_N, "minimum": "@k#"}), "201,422", None, "")], "_arktype")
contract_query("hono", {"a.ts": "import { Hono } from 'hono'\nimport { z } from 'zod'\nconst S = z.object({ @w: z.number().max(@k) })\nconst app = new Hono()\napp.post('/p', zValidator('json', S), (c) => c.json({ id: 1 }, 201))\n"}, [("post", "/p", "", _object(["@w"], w={**_N, "maximum": "@k#"}), "201", _object(["id"], id=_I), "")])
contract_query("fastify", {"a.js": "const fastify = require('fastify')();\nconst item = { type: 'object', properties: { @w: { type: 'integer', maximum: @k } }, required: ['@w'] };\nconst opts = { schema: { body: item, querystring: { type: 'object', properties: { page: { type: 'integer' } } }, response: { 201: item, '4xx': { type: 'null' } } } };\nfastify.post('/@w', opts, async (req, reply) => reply.code(201).send({ zz: 'x' }));\n"},
               [("post", "/@w", "query:page:integer", _object(["@w"], w={**_I, "maximum": "@k#"}), "201,4XX", _object(["@w"], w={**_I, "maximum": "@k#"}), "")], "_schema")
contract_query("elysia", {"a.ts": "import { Elysia, t } from 'elysia'\nconst app = new Elysia()\napp.post('/@w', ({ body }) => body, { body: t.Object({ @w: t.String({ minLength: @k }) }), query: t.Object({ page: t.Optional(t.Integer()) }), response: { 200: t.Object({ zz: t.Integer() }), 404: t.Null() } })\n"},
               [("post", "/@w", "query:page:integer", _object(["@w"], w={**_S, "minLength": "@k#"}), "200,404", _object(["zz"], zz=_I), "")])
contract_query("hono", {"r.ts": "import { Row } from './s'\nexport const route = createRoute({ method: 'put', path: '/@w/{id}', request: { query: z.object({ page: z.number().optional() }), body: { content: { 'application/json': { schema: Row } } } }, responses: { 200: { content: { 'application/json': { schema: Row } }, description: 'x' }, 204: { description: 'y' } } })\n", "s.ts": "export const Row = z.object({ @w: z.number().max(@k) })\n", "a.ts": "import { route } from './r'\nconst app = new OpenAPIHono()\napp.openapi(route, (c) => c.json({ other: 1 }, 200))\n"},
               [("put", "/@w/{id}", "path:id:string,query:page:number", _object(["@w"], w={**_N, "maximum": "@k#"}), "200,204", _object(["@w"], w={**_N, "maximum": "@k#"}), "")], "_route")
contract_query("micronaut", {"M.java": '@Controller("/@w")\nclass M {\n  @Get("/a@k")\n  Row a() { throw new Lost("x"); }\n  @Get("/b")\n  Row b() { throw new HttpStatusException(HttpStatus.CONFLICT, "x"); }\n  @Get("/c")\n  Row c() { throw new Own(); }\n  @Error(exception = Own.class)\n  HttpResponse<Fault> own(Own e) { return HttpResponse.badRequest(new Fault()); }\n}\n',
    "E.java": "class Base extends RuntimeException {}\nclass Lost extends Base {}\nclass Own extends Base {}\nclass Row { int zz; }\nclass Fault { String why; }\n@Singleton\nclass H implements ExceptionHandler<Base, HttpResponse<Fault>> {\n  @Override\n  public HttpResponse<Fault> handle(HttpRequest request, Base e) { return HttpResponse.status(HttpStatus.GONE).body(new Fault()); }\n}\n"}, [
    ("get", "/@w/a@k", "", None, "200,410", {"$ref": "#/components/schemas/Row"}, ""), ("get", "/@w/b", "", None, "200,409", {"$ref": "#/components/schemas/Row"}, ""), ("get", "/@w/c", "", None, "200,400", {"$ref": "#/components/schemas/Row"}, ""),
])
contract_query("nest", {"c.ts": "import { Controller, Post } from '@nestjs/common';\nimport { Dto, Row } from './dto';\n@Controller('@w')\nexport class C {\n  @Post()\n  async make(@Body() dto: Dto, @Query() q: Page): Promise<Row[]> { return this.s.make(dto); }\n}\n",
                        "dto.ts": "export interface Dto { @w: string; zz?: number }\nexport class Row { id!: number; zz: 'a' | 'b' | null; }\nexport type Page = { page?: number; size: number };\n"},
               [("post", "/@w", "query:page:number,query:size:number", {"$ref": "#/components/schemas/Dto"}, "201", {"type": "array", "items": {"$ref": "#/components/schemas/Row"}}, "")])
contract_query("axum", {"m.rs": "use axum::Router;\nfn app() -> Router { Router::new().route(\"/@w/:id\", post(make)) }\nasync fn make(Path(id): Path<i32>, Query(q): Query<Page>, Json(b): Json<Item>) -> (StatusCode, Json<Vec<Item>>) { (StatusCode::CREATED, Json(vec![])) }\nstruct Item { name: String }\nstruct Page { size: Option<u32> }\n"},
               [("post", "/@w/{id}", "path:id:integer,query:size:integer/null", {"$ref": "#/components/schemas/Item"}, "201", {"type": "array", "items": {"$ref": "#/components/schemas/Item"}}, "")])
contract_query("symfony", {"src/C.php": "<?php\nclass C {\n  #[Route('/@w/{id}', methods: ['POST'])]\n  public function make(int $id, #[MapRequestPayload] Dto $dto, #[MapQueryParameter] ?string $q): JsonResponse { return $this->json(new Row($id), 201); }\n}\n", "src/Dto.php": "<?php\nclass Dto { public function __construct(public readonly string $name) {} }\nclass Row { public int $id; }\n"},
               [("post", "/@w/{id}", "path:id:integer,query:q:string/null", {"$ref": "#/components/schemas/Dto"}, "201", {"$ref": "#/components/schemas/Row"}, "")])
contract_query("aspnet", {"C.cs": "[Route(\"@w\")]\npublic class TController : ControllerBase {\n  [HttpPost]\n  public ActionResult<Row> Make([FromBody] Dto d) => Ok();\n}\npublic class Dto { public string Name { get; set; } }\npublic class Row { public int Id { get; set; } }\npublic class V : AbstractValidator<Dto> { public V() { RuleFor(x => x.Name).NotEmpty().MaximumLength(@k); } }\n"},
               [("post", "/@w", "", {"$ref": "#/components/schemas/Dto"}, "200", {"$ref": "#/components/schemas/Row"}, "")])


def _typed(reader: type, kind: str) -> Callable[[str], list]:
    def read(text: str) -> list:
        components: dict = {}
        out = reader({"a": text}, components).schema(kind)
        return [out, sorted(components.items())]

    return read


_A = {"$ref": "#/components/schemas/A"}
value_query("types_typescript", _typed(types.TypeScript, "Promise<A[]>"), [
    ("interface A { @w: string; zz?: number | null }", [{"type": "array", "items": _A}, [["A", _object(["@w"], w=_S, zz={"type": ["number", "null"]})]]]),
    ("type A = '@w' | 'zz';", [{"type": "array", "items": _A}, [["A", {**_S, "enum": ["@w", "zz"]}]]]),
    ("interface B { id: number; zz: Date }\nexport interface A extends B { tags: Record<string, boolean> }", [{"type": "array", "items": _A}, [["A", _object(["id", "zz", "tags"], id=_N, zz={**_S, "format": "date-time"}, tags={"type": "object", "additionalProperties": _B})], ["B", _object(["id", "zz"], id=_N, zz={**_S, "format": "date-time"})]]]),
    ("type A = Pick<B, 'id'> & { '@w': [string, @k] };\nclass B { id: number; private secret: string }", [{"type": "array", "items": _A}, [["A", {"allOf": [_object(["id"], id=_N), _object(["@w"], w={"type": "array", "prefixItems": [_S, {"type": "number", "const": "@k#"}], "minItems": 2, "maxItems": 2})]}], ["B", _object(["id"], id=_N)]]]),
    ("enum A { One = '@w', Two = 'zz' }", [{"type": "array", "items": _A}, [["A", {**_S, "enum": ["@w", "zz"]}]]]),
])
value_query("types_rust", _typed(types.Rust, "Json<Vec<A>>"), [
    ('#[derive(Serialize)]\n#[serde(rename_all = "camelCase")]\npub struct A { pub user_id: i32, #[serde(rename = "@w")] pub other: Option<String>, #[serde(skip)] hidden: u8, #[serde(default)] tags: HashMap<String, f64> }', [{"type": "array", "items": _A}, [["A", _object(["userId"], w={"type": ["string", "null"]}, userId={**_I, "format": "int32"}, tags={"type": "object", "additionalProperties": _N})]]]),
    ('#[serde(rename_all = "snake_case")] enum A { FirstOne, #[serde(rename = "@w")] Other }', [{"type": "array", "items": _A}, [["A", {**_S, "enum": ["first_one", "@w"]}]]]),
    ("struct A { b: B }\nstruct B(Uuid);", [{"type": "array", "items": _A}, [["A", _object(["b"], b={"$ref": "#/components/schemas/B"})], ["B", {**_S, "format": "uuid"}]]]),
])
value_query("types_php", _typed(types.Php, "?A"), [
    ("<?php class A { public int $zid; public ?string $@w = null; /** @var list<B> */ public array $zz; private int $no; } class B { public function __construct(public readonly bool $on) {} }", [{"anyOf": [_A, {"type": "null"}]}, [["A", _object(["zid", "zz"], zid=_I, w={"type": ["string", "null"]}, zz={"type": "array", "items": {"$ref": "#/components/schemas/B"}})], ["B", _object(["on"], on=_B)]]]),
    ("<?php enum A: string { case One = '@w'; case Two = 'zz'; }", [{"anyOf": [_A, {"type": "null"}]}, [["A", {**_S, "enum": ["@w", "zz"]}]]]),
])
value_query("event_schema", _json(variants.event_schema), [
    ('[{"name": "zz", "data": {"const": @k}}, {"name": "@w", "data": {"const": @k}}]', {"type": "object", "properties": {"event": {**_S, "enum": ["@w", "zz"]}, "data": {"const": "@k#"}}, "required": ["event", "data"]}),
    ('[{"name": "@w", "data": {"const": 1}}, {"data": {"const": 2}}]', {"oneOf": [{"const": 1}, {"const": 2}]}), ('[{"name": "@w"}]', {}),
])
value_query("schema_merged_object", _json(lambda v: schemas.merged_object(*v)), [
    ('[{"type": "object", "properties": {"@w": {"const": 1}, "zz": {"type": "object", "properties": {"a": {}}}}}, {"type": "object", "properties": {"@w": {"const": 2}, "zz": {"type": "object", "properties": {"a": {"const": 3}, "b": {"const": @k}}}}}]',
     _object(w={"const": 1}, zz=_object(a={"const": 3}, b={"const": "@k#"}))), ('[{"type": "string"}, {"type": "object", "properties": {"@w": {}}}]', _S),
])
value_query("schema_input_names", _json(lambda v: schemas.input_names(*v)), [
    ('[{"A": {"$ref": "#/components/schemas/B"}, "B": {"const": "@w"}, "C": {"const": 1}}, {"A": {"$ref": "#/components/schemas/B"}, "B": {"const": "out"}, "C": {"const": 1}, "input_B": 0}]', {"A": "input_A", "B": "input_B_2"}), ('[{"@w": {"const": @k}}, {}]', {}),
])
value_query("schema_property_names", _json(schemas.property_names), [('{"properties": {"@w": {}, "constructor": {}, ' + ", ".join(f'"p{i}": {{}}' for i in range(60)) + "}}", ["@w", *(f"p{i}" for i in range(39))])])


@query("""WITH r AS (SELECT l_orderkey AS route, CAST(200 + l_linenumber % 2 AS VARCHAR) AS status, l_shipdate, l_partkey, l_linenumber AS n, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey END AS s, l_partkey % 5 = 0 AS rep,
        CASE WHEN l_suppkey % 4 = 0 THEN 'high' ELSE 'low' END AS c, l_orderkey * 100 + l_linenumber AS o FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k = 1)
    SELECT route, status, 'x' AS media_type, CAST(coalesce(arg_max(s, o) FILTER (rep AND s IS NOT NULL), arg_min(s, o) FILTER (s IS NOT NULL)) AS VARCHAR) AS schema, CASE WHEN bool_or(c = 'high') THEN 'high' ELSE arg_min(c, o) END AS confidence FROM r GROUP BY route, status""")
def collected_responses(table) -> DataFrame:
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"))
    one = table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(first.alias("f")).select("l_orderkey", "l_linenumber", "f.*")
    part = F.col("l_partkey")
    rows = one.select(
        F.col("l_orderkey").alias("route"), (200 + F.col("l_linenumber") % 2).cast("string").alias("status"), F.lit("x").alias("media_type"), F.when(part % 3 != 0, part.cast("string")).alias("schema"),
        (part % 5 == 0).alias("replaces"), F.when(F.col("l_suppkey") % 4 == 0, "high").otherwise("low").alias("confidence"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("o"),
    )
    return variants.collected_responses(rows, ["route"], "o")


@query("""WITH RECURSIVE p AS (SELECT 'n' || n_nationkey AS error, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region),
    h AS (SELECT 'n' || n_nationkey AS error, n_name AS handler FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'r' || r_regionkey, r_name FROM region WHERE r_regionkey % 2 = 0),
    w AS (SELECT c_custkey AS route, 'n' || c_nationkey AS error, 'n' || c_nationkey AS class, 0 AS d FROM customer UNION ALL SELECT route, w.error, parent, d + 1 FROM w JOIN p ON p.error = class),
    m AS (SELECT route, w.error, handler, row_number() OVER (PARTITION BY route ORDER BY d) AS k FROM w JOIN h ON h.error = class) SELECT route, error, handler FROM m WHERE k = 1""")
def exception_handlers(table) -> DataFrame:
    tagged = lambda df, tag, key, *more: df.select(F.concat(F.lit(tag), F.col(key).cast("string")).alias("error"), *more)
    nation, region = table("nation"), table("region")
    parents = tagged(nation, "n", "n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent")).unionByName(tagged(region, "r", "r_regionkey", F.lit("root").alias("parent")))
    handlers = tagged(nation.filter("n_nationkey % 3 = 0"), "n", "n_nationkey", F.col("n_name").alias("handler")).unionByName(tagged(region.filter("r_regionkey % 2 = 0"), "r", "r_regionkey", F.col("r_name").alias("handler")))
    raised = table("customer").select(F.col("c_custkey").alias("route"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("error"))
    return closure.exception_handlers(raised, handlers, parents)


@query("SELECT project, path, 0 AS bytes FROM (SELECT source AS project, 'd' || doc_id % 500 AS path, doc_id < 400 AS own FROM documents) GROUP BY project, path")
def extra_roots(table) -> DataFrame:
    """A project's files and those of an extra root, each path once."""
    docs = table("documents").select(F.col("source").alias("project"), F.concat(F.lit("d"), (F.col("doc_id") % 500).cast("string")).alias("path"), F.lit(0).alias("bytes"), F.col("doc_id"))
    own, extra = (docs.filter(c).select("project", "path", "bytes").distinct() for c in ("doc_id < 400", "doc_id >= 400"))
    return sources.with_extra(own, extra)
