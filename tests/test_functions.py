from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tracewright.functions import ids, paths, text


@pytest.fixture
def ev(spark):
    def run(column, **values):
        kinds = {str: "string", int: "long", list: "array<string>", type(None): "string"}
        df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
        return df.select(column.alias("x")).first()[0]

    return run


def test_stable_id_equals_hashlib(ev):
    want = "node_" + hashlib.sha256("\x1f".join(["a", "None", "7"]).encode()).hexdigest()[:24]
    assert ev(ids.stable_id("node", F.col("a"), F.col("b"), F.col("c")), a="a", b=None, c=7) == want


def test_span_text(spark):
    df = spark.sql("select named_struct('start_line', 1, 'start_column', 2, 'end_line', 3, 'end_column', 4) as s")
    assert df.select(ids.span_text(F.col("s"))).first()[0] == "SourceSpan(start_line=1, start_column=2, end_line=3, end_column=4)"


def test_fingerprint_ignores_the_order_of_fields(spark):
    df = spark.sql("select 1 as b, 'x' as a")
    assert df.select(ids.request_fingerprint("a", "b") == ids.request_fingerprint("b", "a")).first()[0]


@pytest.mark.parametrize(("cursor", "want"), [("MTI=", 12), ("eA==", None), ("!", None), (None, None)])
def test_cursor(ev, cursor, want):
    assert ev(ids.decode_cursor(F.col("c")), c=cursor) == want


def test_cursor_round_trip(ev):
    assert ev(ids.decode_cursor(ids.encode_cursor(F.col("n"))), n=345) == 345


def test_terms(ev):
    assert sorted(ev(text.terms(F.col("t")), t="The Login form-x was in a_b THE login")) == ["a_b", "form-x", "login"]
    assert ev(text.terms(F.col("t")), t=None) == []
    assert "was" in ev(text.terms(F.col("t"), text.RETRIEVAL_STOP), t="was")


def test_claims_have_exact_offsets(ev):
    report = "- Added login form.\n* Tests are passing!\nno end here\nDeployed to production"
    got = ev(text.located_claims(F.col("t")), t=report)
    assert [x["claim"] for x in got] == ["Added login form.", "Tests are passing!", "Deployed to production"]
    assert all(report[x["start"] : x["end"]] == x["claim"] for x in got)


@pytest.mark.parametrize(("claim", "kind"), [("Deployed the tests", "deployment"), ("All tests ran", "test"), ("ci is green", "repository_change"), ("Fixed it", "repository_change")])
def test_claim_type(ev, claim, kind):
    assert ev(text.claim_type(F.col("t")), t=claim) == kind


def test_recency(ev):
    assert ev(text.asks_for_recent_changes(F.col("t")), t="what are the latest commits")
    assert not ev(text.asks_for_recent_changes(F.col("t")), t="what are the commits")


def test_answer_and_refusal(ev):
    assert ev(text.answer(F.col("a")), a=[" x ", "y"]) == "Relevant repository evidence: x; y"
    assert ev(text.answer(F.col("a")), a=[]) == text.REFUSAL


@pytest.mark.parametrize(("cell", "want"), [("=1", "'=1"), ("+x", "'+x"), ("@a", "'@a"), ("-1", "'-1"), ("a=1", "a=1"), ("", "")])
def test_spreadsheet_safe(ev, cell, want):
    assert ev(text.spreadsheet_safe(F.col("c")), c=cell) == want


def test_redact(ev):
    assert ev(text.redact(F.col("t"), F.array(F.lit("s3cret"))), t="a\nurl https://s3cret@x failed\n") == "url https://[REDACTED]@x failed"


@pytest.mark.parametrize(("path", "want"), [("app/../components/button", "components/button"), ("./a//b/.", "a/b"), ("../x", None), ("a/../../x", None), ("a/..", "."), ("/x", None)])
def test_normalise(ev, path, want):
    assert ev(paths.normalise(F.col("p")), p=path) == want


@pytest.mark.parametrize(("path", "want"), [("a/b.TS", ".ts"), ("a.b/c", ""), (".env", ""), ("x.d.ts", ".ts"), ("a.", "")])
def test_suffix(ev, path, want):
    assert ev(paths.suffix(F.col("p")), p=path) == want


def test_candidates(ev):
    c = paths.import_candidates(F.col("s"), F.col("m"))
    assert ev(c, s="src/app/page.tsx", m="../lib/x")[:3] == ["src/lib/x", "src/lib/x.ts", "src/lib/x.tsx"]
    assert ev(c, s="src/app/page.tsx", m="../lib/x")[-1] == "src/lib/x/index.jsx"
    assert ev(c, s="src/a.ts", m="./b.js") == ["src/b.js", "src/b.ts", "src/b.tsx"]
    assert ev(c, s="src/a.ts", m="../../b") == []
    assert ev(c, s="a.ts", m=".")[1:] == ["index.ts", "index.tsx", "index.js", "index.jsx"]


@pytest.mark.parametrize(("name", "want"), [("main", True), ("feature/x-1", True), ("/main", False), ("a..b", False), ("a b", False), ("x.", False), ("x/", False), ("a@{b", False), ("a^b", False), ("a" * 256, False), (None, False)])
def test_refs(ev, name, want):
    assert ev(paths.valid_ref(F.col("n")), n=name) is want


@pytest.mark.parametrize(("url", "want"), [("https://h.com/o/n", "https://h.com/o/n.git"), ("https://h.com/o/n.git", "https://h.com/o/n.git"), ("http://h.com/o/n", None), ("https://t@h.com/o/n", None), ("https://h.com/o", None), ("https://h.com/o/n?x=1", None), ("https://h.com/../n", None), ("https://g.com/o/n", None)])
def test_repository_url(ev, url, want):
    assert ev(paths.normalised_repository(F.col("u"), "h.com"), u=url) == want


def test_specifiers(ev):
    code = "import x, {y} from './a';\nimport './side.css';\n// import z from './no'\n/* require('./no2') */\nconst b = require(\"b\");\nawait import('./c');\nexport * from './re';"
    assert ev(paths.import_specifiers(F.col("t")), t=code) == ["./a", "./side.css", "b", "./c"]


def scanned(code):
    """The specifiers by a walk over the characters: a comment, a string or a template string is passed over as a whole."""
    out, i, before = [], 0, ""
    while i < len(code):
        if code.startswith("/*", i):
            i = code.find("*/", i + 2) + 2
        elif code.startswith("//", i):
            i = code.find("\n", i) if "\n" in code[i:] else len(code)
        elif code[i] in "'\"`":
            j = i + 1
            while code[j] != code[i]:
                j += 2 if code[j] == "\\" else 1
            if before.endswith(("from ", "import ", "require(", "import(")) and not before.endswith(("x.require(", "export * from ", "_import ")):
                out.append(code[i + 1 : j])
            before, i = before + "''", j + 1
        else:
            before, i = before + code[i], i + 1
    return out


def test_specifiers_are_not_taken_from_comments_and_strings(spark):
    import random

    rng = random.Random(3)
    pieces = [
        "import a from './a';", "import {b, c as d} from \"./b\";", "import './side';", "const e = require('./e');", "await import(`./f`);", "// import g from './g'\n", "/* import h from './h'\n require('./i') */",
        "const s = \"import j from './j'\";", "const t = 'require(\"./k\")';", "const u = `import l from './l'\n// ${m}`;", "const v = 'it\\'s // no comment';", "x.require('./n');", "export * from './o';", "\n", "const w = 'http://p'; // q\n",
        "import * as r from './r';", "let my_import = 1;", "const y = \"/* open\";", "import def, {z} from './z';",
    ]
    codes = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(300)] + ["", "import", "// only a comment"]
    df = spark.createDataFrame(list(enumerate(codes)), "i int, t string").select("i", paths.import_specifiers(F.col("t")).alias("x"))
    got = {r.i: r.x for r in df.collect()}
    assert got == {i: scanned(c) for i, c in enumerate(codes)} and sum(map(len, got.values())) > 500


def test_language(ev):
    assert [ev(paths.language(F.col("p")), p=p) for p in ("a.tsx", "a.mts", "a.cjs", "a.py")] == ["tsx", "typescript", "javascript", None]
