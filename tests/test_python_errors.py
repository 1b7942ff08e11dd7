from corvid.packs import registry


def routes(framework, files):
    found = registry()[framework][1](files)
    return {r["full_path"]: r for r in found.routes}, found


def told(route):
    return [(r["status_code"], r["content"][0]["media_type"] if r["content"] else None, r["content"][0]["schema"] if r["content"] else None) for r in route["responses"]]


def test_fastapi_handlers_replace_the_default():
    got, _ = routes("fastapi", {
        "errors.py": "class Base(Exception): ...\nclass Lost(Base): ...\n",
        "app.py": "from fastapi import FastAPI, HTTPException\nfrom fastapi.responses import JSONResponse\nfrom errors import Base, Lost\napp = FastAPI()\n@app.exception_handler(Base)\nasync def base(request, exc): return JSONResponse(status_code=418, content={'code': 1})\n@app.exception_handler(HTTPException)\nasync def http(request, exc): return JSONResponse({'why': 'x'}, status_code=exc.status_code)\n"
        "@app.get('/a')\ndef a():\n    if 1: raise Lost()\n    if 2: raise HTTPException(404)\n    return {'ok': True}\n@app.get('/b', responses={404: {'description': 'mine'}})\ndef b():\n    raise HTTPException(404)\n",
    })
    ok = ("200", "application/json", {"type": "object", "properties": {"ok": {"type": "boolean"}}, "required": ["ok"]})
    why = {"type": "object", "properties": {"why": {"type": "string"}}, "required": ["why"]}
    assert sorted(told(got["/a"]), key=str) == sorted([ok, ("418", "application/json", {"type": "object", "properties": {"code": {"type": "integer"}}, "required": ["code"]}), ("404", "application/json", why)], key=str)
    assert [r["description"] for r in got["/b"]["responses"] if r["status_code"] == "404"] == ["mine"]


def test_defaults_without_handlers():
    got, _ = routes("starlette", {"a.py": "from starlette.applications import Starlette\nfrom starlette.routing import Route\nasync def a(request): raise HTTPException(status_code=403)\nasync def b(request): raise ValueError('x')\napp = Starlette(routes=[Route('/a', a), Route('/b', b)])\n"})
    assert told(got["/a"]) == [("403", "text/plain", {"type": "string"})] and told(got["/b"]) == []
    got, _ = routes("fastapi", {"app.py": "from fastapi import FastAPI, HTTPException\napp = FastAPI()\n@app.get('/a')\ndef a(): raise HTTPException(status_code=404)\n"})
    assert told(got["/a"]) == [("404", "application/json", {"type": "object", "properties": {"detail": {"type": "string"}}})]


def test_marshmallow_decorators_and_nesting():
    got, found = routes("flask", {
        "schemas.py": "from marshmallow import Schema, fields\nclass InnerSchema(Schema):\n    a = fields.Email(required=True)\nclass OuterSchema(Schema):\n    inner = fields.Nested(InnerSchema, many=True)\nclass PageSchema(Schema):\n    page = fields.Int(required=True)\nclass Plain:\n    pass\n",
        "app.py": "from flask import Flask, request\nfrom apifairy import body, response, arguments\nfrom schemas import OuterSchema, PageSchema, Plain\napp = Flask(__name__)\nouter = OuterSchema()\n@app.post('/o')\n@arguments(PageSchema)\n@body(outer)\n@response(OuterSchema(many=True), 201)\ndef o(page, data): return data\n@app.get('/p')\ndef p(): return Plain().dump({})\n",
    })
    ref = {"$ref": "#/components/schemas/Outer"}
    assert got["/o"]["request_body"]["content"][0]["schema"] == ref and told(got["/o"]) == [("201", "application/json", {"type": "array", "items": ref})]
    assert [(p["name"], p["in"], p["required"]) for p in got["/o"]["parameters"]] == [("page", "query", True)]
    assert found.components["Outer"]["properties"]["inner"] == {"type": "array", "items": {"$ref": "#/components/schemas/Inner"}} and found.components["Inner"]["required"] == ["a"]
    assert told(got["/p"]) == [("200", "application/json", {})]
