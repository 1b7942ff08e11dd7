from corvid.packs import registry

ID = {"type": "object", "properties": {"id": {"type": "integer"}}, "required": ["id"]}


def routes(framework, files):
    return {(r["method"], r["full_path"]): r for r in registry()[framework][1](files).routes}


def told(route):
    return [(r["status_code"], r["content"][0]["schema"] if r["content"] else None) for r in route["responses"]]


def test_fastify_schemas():
    got = routes("fastify", {
        "s.js": "const item = { type: 'object', properties: { id: { type: 'integer' } }, required: ['id'] };\nmodule.exports = { item };\n",
        "a.js": "const fastify = require('fastify')();\nconst { item } = require('./s');\nconst opts = { schema: { querystring: { type: 'object', properties: { page: { type: 'integer', minimum: 1 } }, required: ['page'] }, response: { 200: item, '4xx': { type: 'null' } } } };\n"
        "fastify.get('/x/:id', opts, async (req, reply) => reply.send({ id: 'wrong' }));\n"
        "fastify.route({ method: 'POST', url: '/r', schema: { body: item, params: { type: 'object', properties: {} } }, handler: (req, reply) => reply.code(201).send({ ok: true }) });\n",
    })
    x = got["get", "/x/{id}"]
    assert told(x) == [("200", ID), ("4XX", {"type": "null"})] and x["gaps"] == []
    assert [(p["name"], p["in"], p["required"], p["schema"]) for p in x["parameters"]][1] == ("page", "query", True, {"type": "integer", "minimum": 1})
    r = got["post", "/r"]
    assert r["request_body"]["content"][0]["schema"] == ID and [s for s, _ in told(r)] == ["201"]


def test_elysia_hooks():
    got = routes("elysia", {"a.ts": "import { Elysia, t } from 'elysia'\nconst app = new Elysia()\napp.post('/x/:id', ({ body }) => body, { body: t.Object({ a: t.String() }), params: t.Object({ id: t.Number() }), response: { 200: t.Object({ id: t.Integer() }), 404: t.Null() } })\napp.get('/one', () => 1, { response: t.Object({ id: t.Integer() }) })\napp.get('/two', () => 2)\n"})
    x = got["post", "/x/{id}"]
    assert x["request_body"]["content"][0]["schema"]["properties"] == {"a": {"type": "string"}} and x["parameters"][0]["schema"] == {"type": "number"}
    assert [s for s, _ in told(x)] == ["200", "404"] and told(x)[0][1] == ID and told(got["get", "/one"]) == [("200", ID)] and told(got["get", "/two"]) == []


def test_hono_create_route():
    got = routes("hono", {"a.ts": "import { OpenAPIHono, createRoute, z } from '@hono/zod-openapi'\nconst app = new OpenAPIHono()\nconst Row = z.object({ id: z.number().int() }).openapi('Row')\nconst route = createRoute({ method: 'put', path: '/x/{id}', request: { params: z.object({ id: z.string() }), query: z.object({ q: z.string().optional() }), body: { content: { 'application/json': { schema: Row } } } }, responses: { 200: { content: { 'application/json': { schema: Row } }, description: 'fine' }, 204: { description: 'gone' } } })\napp.openapi(route, (c) => c.json({ other: 1 }, 200))\n"})
    x = got["put", "/x/{id}"]
    assert [(p["name"], p["in"], p["required"]) for p in x["parameters"]] == [("id", "path", True), ("q", "query", False)]
    assert x["request_body"]["content"][0]["schema"] == ID and told(x) == [("200", ID), ("204", None)] and x["responses"][0]["description"] == "fine"


def test_hono_route_of_another_file():
    got = routes("hono", {"r.ts": "import { Row } from './s'\nexport const route = createRoute({ method: 'get', path: '/y', responses: { 200: { content: { 'application/json': { schema: Row } }, description: '' } } })\n", "s.ts": "export const Row = z.object({ id: z.number().int() })\n", "a.ts": "import { route } from './r'\nconst app = new OpenAPIHono()\napp.openapi(route, handle)\nfunction handle(c) { return c.json({}) }\n"})
    assert told(got["get", "/y"]) == [("200", ID)]
