from corvid.packs import registry
from corvid.sources.models import nullable, of_object

PRISMA = "model User {\n  id Int @id\n  name String?\n  posts Post[]\n}\nmodel Post {\n  id Int @id\n  title String\n}\n"
USER = of_object({"id": {"type": "integer"}, "name": {"type": ["string", "null"]}})


def told(framework, files):
    """The schema of each route's first response with a body, by method and path."""
    found = registry()[framework][1](files)
    return {(r["method"], r["full_path"]): [(x["status_code"], x["content"][0]["schema"]) for x in r["responses"] if x["content"]] for r in found.routes}


def test_prisma_in_express():
    got = told("express", {
        "prisma/schema.prisma": PRISMA,
        "a.ts": "const express = require('express');\nconst app = express();\nconst prisma = new PrismaClient();\n"
        "app.get('/users', async (req, res) => { const users = await prisma.user.findMany({\n  select: { id: true, posts: { select: { title: true } } },\n});\n res.json({ users, n: users.length }); });\n"
        "app.get('/users/:id', async (req, res) => { const user = await prisma.user.findUnique({ where: { id: 1 } }); if (!user) return res.status(404).json({ error: 'x' }); res.json(user); });\n"
        "app.get('/maybe', async (req, res) => { res.json(await prisma.user.findFirst()); });\n"
        "app.get('/page', async (req, res) => { const [items, total] = await Promise.all([prisma.post.findMany(), prisma.post.count()]); res.json({ items, total, first: items.map(x => x.id) }); });\n"
        "app.get('/other', async (req, res) => { let u = await prisma.user.create({}); u = other(u); res.json(u); });\n"
        "app.get('/decoy', async (req, res) => { res.json(await cache.user.count()); });\n"
        "app.get('/odd', async (req, res) => { res.json(await prisma.user.aggregate({})); });\n",
    })
    row = of_object({"id": {"type": "integer"}, "posts": {"type": "array", "items": of_object({"title": {"type": "string"}})}})
    assert got["get", "/users"] == [("200", of_object({"users": {"type": "array", "items": row}, "n": {"type": "integer"}}))]
    assert got["get", "/users/{id}"] == [("404", of_object({"error": {"type": "string"}})), ("200", USER)]
    assert got["get", "/maybe"] == [("200", nullable(USER))]
    post = of_object({"id": {"type": "integer"}, "title": {"type": "string"}})
    assert got["get", "/page"] == [("200", of_object({"items": {"type": "array", "items": post}, "total": {"type": "integer"}, "first": {}}))]
    assert got["get", "/other"] == got["get", "/decoy"] == got["get", "/odd"] == [("200", {})]


def test_mongoose_in_koa_and_express():
    model = "const s = new Schema({ name: String, secret: { type: String, select: false } }, { versionKey: false });\nconst Thing = mongoose.model('Thing', s);\nmodule.exports = Thing;\n"
    row = of_object({"_id": {"type": "string"}, "name": {"type": "string"}})
    got = told("koa", {"m.js": model, "a.js": "const Koa = require('koa'); const Router = require('@koa/router');\nconst app = new Koa();\nconst router = new Router();\nrouter.get('/t', async ctx => { ctx.body = await Thing.find({}).sort('x').lean(); });\nrouter.get('/u', async ctx => { ctx.body = await Thing.find({}).then(x => 1); });\napp.use(router.routes());\n"})
    assert got["get", "/t"] == [("200", {"type": "array", "items": row})] and got["get", "/u"] == [("200", {})]
    got = told("express", {"m.js": model, "a.js": "const app = express();\napp.post('/t', async (req, res) => { const made = await Thing.create(req.body); res.status(201).json({ id: made._id, made }); });\napp.get('/s', async (req, res) => { const t = await Thing.ownStatic(); res.json(t); });\n"})
    assert got["post", "/t"] == [("201", of_object({"id": {"type": "string"}, "made": row}))] and got["get", "/s"] == [("200", {})]


def test_sequelize_and_returned_rows():
    define = "const User = sequelize.define('User', { name: { type: DataTypes.STRING, allowNull: false } });\n"
    row = of_object({"id": {"type": "integer"}, "name": {"type": "string"}})
    got = told("fastify", {"m.js": define, "a.js": "const fastify = require('fastify')();\nfastify.get('/u', async (req, reply) => { const { rows, count } = await User.findAndCountAll(); return { rows, total: count }; });\nfastify.get('/one', async (req, reply) => { const u = await User.findByPk(1); if (u === null) { return reply.code(404).send({ no: 1 }); }\n return u; });\nfastify.get('/lit', async () => ({ ok: true }));\nfastify.get('/no', async (req, reply) => { const x = [1].map(y => { return 'in'; }); return other(x); });\n"})
    assert got["get", "/u"] == [("200", of_object({"rows": {"type": "array", "items": row}, "total": {"type": "integer"}}))]
    assert got["get", "/one"] == [("404", of_object({"no": {"type": "integer"}})), ("200", row)]
    assert got["get", "/lit"] == [("200", of_object({"ok": {"type": "boolean"}}))] and got["get", "/no"] == []


def test_prisma_service_in_nest():
    got = told("nest", {"prisma/schema.prisma": PRISMA, "s.ts": "export class PrismaService extends PrismaClient {}", "c.ts": "@Controller('u')\nexport class C {\n  constructor(private readonly prisma: PrismaService) {}\n  @Get()\n  async all() { return this.prisma.user.findMany(); }\n}\n"})
    assert got["get", "/u"] == [("200", {"type": "array", "items": USER})]


def test_prisma_files_are_scanned(spark, tmp_path):
    import json

    from corvid.plans.scan import scan_project

    app = "const express = require('express');\nconst app = express();\nconst prisma = new PrismaClient();\napp.get('/u', async (req, res) => { res.json(await prisma.user.findMany()); });\n"
    for name, text in {"package.json": json.dumps({"dependencies": {"express": "4"}}), "prisma/schema.prisma": PRISMA, "app.js": app, "x/other.prisma": "model User {\n  no Int\n}\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (got,) = scan_project(spark, str(tmp_path)).operations.collect()
    assert json.loads(got.candidate)["responses"][0]["content"][0]["schema"] == {"type": "array", "items": USER}
