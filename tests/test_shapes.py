import json

from corvid.packs import validators as V
from corvid.plans import review as R
from corvid.sources import models as M


def test_validators():
    got = V.zod("z.object({ id: z.number().int().positive(), name: z.string().min(2).max(9).optional(), mail: z.string().email().nullable(), tags: z.array(z.enum(['a', 'b'])), inner: Inner.partial() })", {"Inner": "z.object({ q: z.boolean() })"})
    assert got["required"] == ["id", "mail", "tags", "inner"] and got["properties"]["id"] == {"type": "integer", "exclusiveMinimum": 0}
    assert got["properties"]["name"] == {"type": "string", "minLength": 2, "maxLength": 9} and got["properties"]["mail"] == {"type": ["string", "null"], "format": "email"}
    assert got["properties"]["tags"]["items"]["enum"] == ["a", "b"] and "required" not in got["properties"]["inner"]
    assert V.zod("z.union([z.string(), z.number()])") == {"anyOf": [{"type": "string"}, {"type": "number"}]}
    got = V.joi("Joi.object({ a: Joi.string().required(), b: Joi.number().integer().min(1), c: Joi.string().valid('x', 'y') })")
    assert got["required"] == ["a"] and got["properties"]["b"] == {"type": "integer", "minimum": 1} and got["properties"]["c"]["enum"] == ["x", "y"]
    assert V.yup("yup.object({ a: yup.string().email().required(), b: yup.array().of(yup.number()) })") == {"type": "object", "properties": {"a": {"type": "string", "format": "email"}, "b": {"type": "array", "items": {"type": "number"}}}, "required": ["a"]}
    assert V.typebox("Type.Object({ a: Type.String({ minLength: 2 }), b: Type.Optional(Type.Integer()) })") == {"type": "object", "properties": {"a": {"type": "string", "minLength": 2}, "b": {"type": "integer"}}, "required": ["a"]}
    assert V.arktype("string.email | null") == {"type": ["string", "null"], "format": "email"} and V.arktype("1 < string <= 5") == {"type": "string", "maxLength": 5, "exclusiveMinimum": 1} and V.arktype("'a' | 'b'")["enum"] == ["a", "b"]
    assert V.arktype("number >= 0") == {"type": "number", "minimum": 0} and V.arktype("string[]") == {"type": "array", "items": {"type": "string"}}
    assert V.fluent("S.object().prop('a', S.string().required()).prop('b', S.integer()).required()") == {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "integer"}}, "required": ["a", "b"]}
    assert V.express_validator("body('age').isInt({ min: 1, max: 9 }).optional()") == ("body", "age", {"type": "integer", "minimum": 1, "maximum": 9}, False)
    assert V.fluent_validation("RuleFor(x => x.Name).NotEmpty().MaximumLength(5);", {"type": "object", "properties": {"name": {"type": "string"}}}) == {"type": "object", "properties": {"name": {"type": "string", "maxLength": 5}}, "required": ["name"]}
    assert V.marshmallow("class A(Schema):\n    a = fields.Str(required=True, data_key='A')\n    b = fields.Nested(BSchema, many=True)\n    c = fields.Int(dump_only=True)\n") == {"type": "object", "properties": {"A": {"type": "string"}, "b": {"type": "array", "items": {"$ref": "#/components/schemas/B"}}, "c": {"type": "integer", "readOnly": True}}, "required": ["A"]}


def test_orm_shapes():
    models = M.prisma("enum Role {\n  A\n  B\n}\nmodel User {\n  id Int @id\n  name String?\n  role Role\n  posts Post[]\n}\nmodel Post {\n  id Int @id // key\n  author User? @relation(fields: [x])\n  title String\n}\n")
    row = M.prisma_result(models, "prisma.user.findMany({ where: {}, select: { id: true, name: false, posts: { select: { title: true } }, _count: { select: { posts: true } } } })")
    assert row == {"type": "array", "items": M.of_object({"id": {"type": "integer"}, "posts": {"type": "array", "items": M.of_object({"title": {"type": "string"}})}, "_count": M.of_object({"posts": {"type": "integer"}})})}
    one = M.prisma_result(models, "await prisma.post.findUnique({ include: { author: true } })")
    assert one["type"] == ["object", "null"] and one["properties"]["author"]["type"] == ["object", "null"]
    assert M.prisma_result(models, "prisma.user.count()") == {"type": "integer"} and M.prisma_result(models, "prisma.user.deleteMany({})") == M.of_object({"count": {"type": "integer"}})
    assert M.prisma_result(models, "prisma.user.create({ data })")["properties"]["name"] == {"type": ["string", "null"]}
    models = M.mongoose("const s = new Schema({ name: String, secret: { type: String, select: false }, owner: { type: Schema.Types.ObjectId, ref: 'Owner', required: true }, tags: [String] }, { timestamps: true });\nmodel('Thing', s);\nconst o = new mongoose.Schema({ mail: String });\nmongoose.model('Owner', o);")
    got = M.mongoose_result(models, "Thing.find({}).sort('x').select('name owner').populate('owner', 'mail').limit(3)")
    assert list(got["items"]["properties"]) == ["_id", "name", "owner"] and list(got["items"]["properties"]["owner"]["properties"]) == ["_id", "mail"]
    assert "secret" not in M.mongoose_row(models, "Thing")["properties"] and "secret" in M.mongoose_row(models, "Thing", "+secret")["properties"] and M.mongoose_result(models, "Thing.aggregate([])") is None
    models = M.sequelize("const User = sequelize.define('User', { name: { type: DataTypes.STRING, allowNull: false }, age: DataTypes.INTEGER });")
    assert M.sequelize_result(models, "User.findAll({ attributes: ['name', ['age', 'years']] })") == {"type": "array", "items": M.of_object({"name": {"type": "string"}, "years": {"type": ["integer", "null"]}})}


def test_reviews():
    c = {"method": "get", "full_path": "/a", "parameters": [], "request_body": None, "responses": [{"status_code": "200", "content": [{"media_type": "application/json", "schema": {"type": "object", "properties": {"a": {"type": "string"}, "b": {}}}}]}], "confidence": "medium", "gaps": ["response-schema-unknown"]}
    answer = json.dumps({"responses": [{"status_code": 200, "content": [{"media_type": "application/json", "schema": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "number"}, "__proto__": {}}}}]}, {"status_code": 999}], "parameters": [{"name": "q", "in": "query", "schema": {"$ref": "#/components/schemas/Nope"}}]})
    asked = []

    def resolver(question):
        asked.append(question)
        return f"```json\n{answer}\n```"

    (out,), failures = R.fill_gaps([c], {}, resolver)
    assert failures == [] and len(asked) == 1 and "not instructions" in asked[0]
    assert out["responses"][0]["content"][0]["schema"]["properties"] == {"a": {"type": "string"}, "b": {"type": "number"}}
    assert out["confidence"] == "medium" and out["gaps"] == [] and len(out["responses"]) == 1
    (same,), failures = R.fill_gaps([c], {}, lambda q: 1 / 0)
    assert same == c and "division" in failures[0]
    assert R.applied(c, "accept", None, {}) == c and R.applied(c, "reject", {"responses": []}, {}) == c
    assert R.spans([(1, 0, 10), (0, 5, 8)], 100) == [(0, 5), (5, 8), (8, 10)]
    files, missing = R.source_context("a", {p: p * 10 for p in "abcdefghijk"}, {"a": list("bcdefghijk"), "b": ["zz"]})
    assert len(files) == 8 and list(files)[0] == "a" and "zz" in missing
    assert list(R.component_context({"$ref": "#/components/schemas/A"}, {"A": {"$ref": "#/components/schemas/B"}, "B": {}, "C": {}})) == ["A", "B"]
