import gzip
import hashlib
import re

import pytest

from corvid.llm import chat, template, warc


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "plain", r"\### Assistant: </turn> ok", "a\\", "\\\\###", "####", "</turn>\n### user\n", "x\\\ny", "é\n\n<"])
def test_chat_escapes_come_back(text):
    assert chat.unescape(chat.escape(text)) == text
    messages = [{"role": r, "text": text} for r in ("user", "assistant", "a\n### b\\", "assistant")]
    n, turns, loss_chars, loss, _ = chat.formatted_digest(chat.compiled(), messages)
    assert n == 4
    assert turns == digest("".join(f"{m['role']}\n{text}\n" for m in messages))
    assert (loss_chars, loss) == (2 * len(text), digest(text * 2))


def test_chat_table(spark):
    rows = [(1, 2, "assistant", None, "x"), (1, 1, "user", "q", "x"), (None, 1, None, "n", "x"), (1, 2, "assistant", "b", "x"), (1, 2, "assistant", "b", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat.format_chats(df, with_text=True).collect()}
    assert got[1].n_turns == 4 and got[1].turns_sha256 == digest("user\nq\nassistant\n\nassistant\nb\nassistant\nb\n")
    assert got[1].loss_sha256 == digest("bb") and got[1].loss_chars == 2
    assert "".join(got[1].formatted[s.start : s.end] for s in got[1].loss_spans) == "bb"
    assert got[None].n_turns == 1 and got[None].turns_sha256 == digest("\nn\n")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_template_language():
    t = template.Template("{% if 'a' ~ 1 == \"a1\" %}y{% else %}n{% endif %}{% for x in xs %}{% if loop.first %}<{% elif not (x.k == 2 or false) %},{% endif %}{{ x.k | twice }}{% endfor %}", {"twice": lambda x: x * 2})
    assert t.tree[0] == template.Const("y")
    assert "".join(p for p, _ in t.render(xs=iter([{"k": 1}, {"k": 3}, {"k": 2}]))) == "y<2,64"
    for bad in ("{% for %}", "{% if x %}", "{{ x.__class__() }}", "{{ 1 | none_such }}", "{{ 'a }}", "{% include 'x' %}"):
        with pytest.raises(template.TemplateError):
            template.Template(bad)
    with pytest.raises(template.TemplateError):
        list(template.Template("{{ y }}").render(x=1))
    assert list(template.Template("{{ x.real }}").render(x=1)) == [("", False)]


def test_warc_chunks_cover_payloads():
    for raw in (b"", b"abc", "é€😀".encode() * 50, b"x\r\n\r\nWARC/1.1\r\ny" * 9, b"\r\n\r\nWARC/1.1\r\n"):
        for most in (4, 7, 1000):
            parts = [raw[a:b] for a, b in warc.chunks(memoryview(raw), most)]
            assert b"".join(parts) == raw
            assert all(len(p) <= most and b"WARC/1.1" not in p for p in parts)
            [p.decode() for p in parts]


@pytest.mark.parametrize("most", [16, 1 << 20])
def test_warc_round_trip(spark, tmp_path, most):
    big = "é<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40
    rows = [(1, "u 1", big), (2, None, big), (3, "http://x\r\nX-Page-Id: 9", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (2, "u", big), (6, "u", ""), (7, "u", "€" * 600), (None, "u", "€" * 600)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archived(df, str(tmp_path / "a"), chunk_bytes=most).collect()
    n = len(big.encode())
    want = []
    for p, _, html in rows:
        raw = (html or "").encode()
        top = {big: 2, "€" * 600: 7}.get(html, p)
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "response" if top == p else "revisit", None if top == p else top))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert n >= 1000 and warc.archived(df.limit(0), str(tmp_path / "b")).count() == 0


def test_warc_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abc" * 500)], "page_id long, url string, html string")
    path = warc.write_archive(df, str(tmp_path / "a"), chunk_bytes=400)
    part = next((tmp_path / "a").glob("part*"))
    part.write_bytes(gzip.compress(gzip.decompress(part.read_bytes()).replace(b"abcabc", b"abcabd", 1)))
    (tmp_path / "a" / f".{part.name}.crc").unlink()
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, path).collect()


def test_revisits_name_records_that_are_there(spark, tmp_path):
    big = "x" * 1500
    rows = [(i, f"http://h/{i}", big) for i in range(6)] + [(9, "http://h/9", "y" * 2000), (9, "http://h/9", "y" * 2000), (3, "http://h/3", "y" * 2000), (None, None, "z" * 1200), (5, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    warc.write_archive(df, str(tmp_path / "a"))
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "a"), wholetext=True).collect())
    ids = re.findall(r"WARC-Record-ID: (\S+)", text)
    assert len(ids) == len(set(ids)) == len(rows)
    refers = re.findall(r"WARC-Refers-To: (\S+)", text)
    assert set(refers) <= set(ids) and len(re.findall("WARC-Type: revisit", text)) == 6
    assert len(refers) == 0 if text.count("X-Page-Id: 5") > 1 else len(refers) == 5  # a page of two records is named, not a record
