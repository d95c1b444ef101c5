import math

from pyspark.sql import functions as F

from codeloom.functions import embed, vectors
from codeloom.functions import scalars as S
from codeloom.operators import lookup
from codeloom.operators.vector import pack_batches


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(*values):
    return [F.lit(v) for v in values]


def test_identities(spark):
    path, name, kind, line = lit("src/auth/middleware.py", "verify_token", "function", 42)
    none = F.lit(None).cast("string")
    exact = lambda s: S.symbol_key_exact(F.lit("k"), F.lit(s))
    r = one(
        spark,
        id=S.symbol_id(path, name, kind, line),
        key=S.symbol_key(F.lit("src.auth.middleware"), path, none, name, kind),
        fallback=S.symbol_key(F.lit(""), path, none, name, kind),
        method=S.symbol_key(F.lit("src.auth"), path, *lit("AuthService", "verify", "method")),
        a=exact("def f(  x: int,  y: str  ) -> bool"),
        b=exact("def f(x: int, y: str) -> bool"),
        c=exact("def f(y: str, x: int) -> bool"),
        space=exact("def\u00a0f(x: int ,y: str) -> bool"),
    )
    assert r.id == "src/auth/middleware.py:verify_token:function:42"
    assert r.key == r.fallback == "src.auth.middleware.verify_token:function"
    assert r.method == "src.auth.AuthService.verify:method"
    assert r.a == r.b == r.space != r.c


def test_contents(spark):
    texts = ["line1\nline2\nline3\n", "", "a", "a\r\nb\rc", "x  \ny\t\n\n", "a\u2028b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.content_lines(F.col("t")).alias("n"), S.normalized_content(F.col("t")).alias("c")).collect()
    assert [r.n for r in rows] == [len(t.splitlines()) for t in texts]
    assert [r.c for r in rows][:5] == ["line1\nline2\nline3", "", "a", "a\nb\nc", "x\ny\n"]
    r = one(spark, window=S.chunk_id(F.lit(False), F.lit("k"), *lit("src/config.py", 1, "c")), symbol=S.chunk_id(F.lit(True), F.lit("k"), *lit("src/config.py", 1, "c")))
    assert r.window.startswith("src/config.py:window:1:") and len(r.window.split(":")[-1]) == 8 and r.symbol == "k"


def test_tokens_and_previews(spark):
    r = one(
        spark, a=S.batch_tokens(F.lit("a" * 100)), b=S.batch_tokens(F.lit("")), c=S.text_tokens(F.lit("")), d=S.file_tokens(F.lit(401)), e=S.preview(F.lit("x" * 300)), f=S.preview(F.lit("x")),
        g=S.human_tokens(F.lit(5200)), h=S.human_tokens(F.lit(1300000)), i=S.human_tokens(F.lit(7)), j=S.tokens_saved(*lit(5, 9)), k=S.progress_bar(*lit(5, 10)), m=S.collapsed(F.lit("a/./b/../c/../../d")),
    )
    assert (r.a, r.b, r.c, r.d) == (25, 1, 0, math.ceil(401 * 0.75))
    assert len(r.e) == 203 and r.e.endswith("...") and r.f == "x"
    assert (r.g, r.h, r.i, r.j, r.k, r.m) == ("~5.2k", "~1.3M", "~7", 0, "[##########----------]", "d")


def test_languages_and_globs(spark):
    paths = ["a.py", "x.d.ts", "b.tsx", "h.h", "noext", "A.PY", "vendor/x.py", "a/b.min.js", "b.min.js", "dir.py/file"]
    globs = ["vendor/**", "generated/**", "**/*.min.js"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(S.language_of(F.col("p")).alias("l"), S.excluded(F.col("p"), globs).alias("x")).collect()
    assert [r.l for r in rows] == ["python", "typescript", "tsx", None, None, None, "python", "javascript", "javascript", None]
    assert [r.x for r in rows] == [False] * 6 + [True, True, False, False]


def test_vectors(spark):
    v = lambda x: F.array(*[F.lit(float(i)) for i in x])
    states = F.array(v([2, 4, 6]), v([4, 8, 12]), v([100, 100, 100]))
    r = one(
        spark, u=vectors.normalized(v([3, 4])), z=vectors.normalized(v([0, 0])), t=vectors.truncated(v([1, 2, 3, 4]), 2), d=vectors.squared_l2(v([1, 2]), v([4, 6])),
        m=vectors.masked_mean(states, F.array(*lit(1, 1, 0))), n=vectors.masked_mean(F.array(v([1, 2])), F.array(F.lit(0))),
    )
    assert r.u == [0.6, 0.8] and r.z == [0, 0] and r.t == [1, 2] and r.d == 25 and r.m == [3, 6, 9] and r.n == [0, 0]
    codes = one(spark, c=S.char_codes(F.lit("ab" * 400))).c
    assert len(codes) == 512 and codes[:2] == [97, 98]


def test_batches():
    assert len(pack_batches([1] * 10, most=3)) >= 4
    assert len(pack_batches([100] * 5, tokens=150)) == 5
    assert pack_batches([]) == []
    assert pack_batches([9000, 10]) == [[0], [1]]
    assert sorted(i for b in pack_batches(list(range(1, 200)), tokens=500) for i in b) == list(range(199))


def test_cursors(spark):
    assert lookup.decode_cursor(lookup.encode_cursor(150)) == 150
    assert [lookup.decode_cursor(x) for x in (None, "", "!!", "bm8=", lookup.encode_cursor(-4))] == [0] * 5
    assert one(spark, c=lookup.cursor_column(F.lit(50))).c == lookup.encode_cursor(50)


def test_embedders(spark, monkeypatch):
    import io
    import json
    import urllib.error

    import numpy as np
    import pytest

    hashing = embed.build("Hashing", dimension=32)
    a, b = hashing(["one two", ""])
    assert abs(sum(x * x for x in a) - 1) < 1e-6 and not any(b)
    with pytest.raises(embed.ProviderUnavailable):
        embed.build("nothing")
    with pytest.raises(embed.ProviderUnavailable):
        embed.build("openai", api_key_env="SURELY_UNSET_KEY")
    assert embed.masked_mean(np.array([[[2, 4, 6], [4, 8, 12], [9, 9, 9]]]), np.array([[1, 1, 0]])).tolist() == [[3, 6, 9]]
    pauses, answers = [], [urllib.error.HTTPError("u", 429, "", {}, None)] * 2 + [io.BytesIO(json.dumps({"ok": 1}).encode())]

    def open_(*_, **__):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert embed.post("http://x", "k", {}, sleep=pauses.append, open_=open_) == {"ok": 1} and pauses == [1, 2]
    assert embed.back_off(9) == 30
    out = embed.with_vectors(spark.createDataFrame([("a b",), (None,)], "embedding_text string"), dimension=8).collect()
    assert [len(r.vector) for r in out] == [8, 8] and all(r.has_vector for r in out)
    assert embed.embed_batches(lambda texts: 1 / 0, ["a"]) == [None]
