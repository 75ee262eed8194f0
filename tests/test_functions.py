import math
import random
from urllib.parse import parse_qsl, unquote_plus, urlparse

import pytest
from pyspark.sql import functions as F

from gatewarden.functions import arrow
from gatewarden.functions import text as X
from gatewarden.operators import structure


@pytest.fixture
def value(spark):
    def of(column, **values):
        return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first()["v"]

    return of


URLS = ["/a/b;p=1?x=1#f", "http://h.example/a/?y=1&x=2", "https://h/p;q/r;s=1;t?a=b?c", "//h/x", "/a?x=<script>&y=%27 or 1", "?q=1", "#f", "", "a b<c", "/x;y/z", "HTTP://H/P?#", "/p?a=1#b?c=2"]


def test_url_parts_like_urllib(frame):
    for r in frame([(u,) for u in URLS], "u string").select("u", X.url_parts(F.col("u")).alias("p")).collect():
        p = urlparse(r.u)
        assert tuple(r.p) == (p.scheme, p.netloc, p.path, p.params, p.query, p.fragment), r.u


def test_query_pairs_like_urllib(frame):
    random.seed(3)
    queries = ["a=1&b=&c&a=2&d=x=y;e=1", "", "&&=v&k=%41+b"] + ["".join(random.choice("ab=&%41+é;") for _ in range(12)) for _ in range(60)]
    for r in frame([(q,) for q in queries], "q string").select("q", X.query_pairs(F.col("q")).alias("p")).collect():
        assert [tuple(x) for x in r.p] == parse_qsl(r.q), r.q


def test_unquote_plus_like_urllib(frame):
    for r in frame([(s,) for s in ["100%25+%zz", "%e9", "a+b", "%", "%4", "%C3%A9", "plain", "%%41"]], "s string").select("s", X.unquote_plus(F.col("s")).alias("u")).collect():
        assert r.u == unquote_plus(r.s, errors="replace"), r.s


def test_fix_point(frame):
    df = frame([("%252527",), ("a%2525252527",), (None,)], "s string")
    assert [r.a for r in df.select(arrow.unquoted_fully(F.col("s")).alias("a")).collect()] == ["'", "a'", None]
    assert [r.a for r in df.select(X.unquote_fully(F.col("s")).alias("a")).collect()] == ["'", "a'", None]


@pytest.mark.parametrize(
    ("method", "url", "body", "want"),
    [
        ("POST", "/Tienda1/Publico/Anadir.jsp?x=1", "b=2&a=1", "POST|tienda1_publico_anadir.jsp|a_b"),
        ("GET", "/a/?y=1&x=2", "", "GET|a|x_y"),
        ("get", None, None, "GET||"),
    ],
)
def test_identifier(value, method, url, body, want):
    assert value(structure.identifier(F.col("m"), F.col("u").cast("string"), F.col("b").cast("string")), m=method, u=url, b=body) == want


def test_json_body_identifier(frame):
    df = frame([("POST", "/a", '{"b": 1, "a": "x"}', {"Content-Type": "application/json"}), ("POST", "/a", "c=1", None), ("POST", "/a", "[1]", {"content-type": "application/json"})], "method string, url string, body string, headers map<string,string>")
    assert [r.identifier for r in structure.identified(df, json=True).collect()] == ["POST|a|a_b", "POST|a|c", "POST|a|"]


def test_http_parts(value):
    got = value(X.http_parts(F.col("m"), F.col("u"), F.col("b")), m="POST", u="/tienda1/miembros/editar.jsp", b="modo=insertar&login=ase")
    assert got == ["POST", "/tienda1", "/miembros", "/editar.jsp", "modo=insertar", "login=ase"]
    got = value(X.http_parts(F.col("m"), F.col("u"), F.col("b"), True, F.col("h")), m="GET", u="/a/b?x=1& &y=2", b="{raw & body}", h="A: 1\n\nB: 2")
    assert got == ["GET", "/a/b", "x=1", "y=2", "A: 1", "B: 2", "{raw & body}"]


def test_word_tokens(value):
    got = value(X.word_tokens(X.prompt(F.col("m"), F.col("u"), F.col("b"))), m="GET", u="/a?x=1&y=%27", b="")
    assert got == ["Method", "GET", "URL", "a", "x", "1", "y", "Body"]


def test_alignment(value):
    got = value(X.aligned(F.array(F.lit("a%27b"), F.lit("x=1")), X.word_tokens))
    assert [(x.part, x.tokens) for x in got] == [("a'b", ["a", "b"]), ("x=1", ["x", "1"])]


def test_custom_body_and_lines(value):
    assert value(X.custom_body(F.lit("{a:1, b:2}"))) == ["a:1", "b:2"]
    assert value(X.clean_line(F.lit(' a "b"\t c '))) == "a b c"
    assert value(X.clean_string(F.lit("a\x00b\x7f\x1fc"))) == "abc"


def test_value_shape_over_unicode(frame):
    points = [chr(c) for c in range(0x20, 0x3000) if not 0xD800 <= c < 0xE000]
    for r in frame([(c,) for c in points], "c string").select("c", X.value_shape(F.col("c")).alias("s")).collect():
        want = "A" if r.c.isalpha() else "N" if r.c.isdigit() else "S"
        if r.s != want:  # characters of newer versions of Unicode, and digits of rare scripts
            assert not (r.c.isascii() or r.c in "²³¹éß"), (r.c, r.s)


def test_shape_codes(value):
    assert value(X.value_shape(F.lit("abc-12"))) == "AAASNN"
    assert value(X.shape_codes(F.lit("a1-"))) == [65, 78, 83]


LABELS = [
    ("… Final Classification: SQL Injection", 1, "SQL Injection"),
    ("Final Classification: Remote Code Execution (RCE)", 8, "Remote Code Execution"),
    ("Final Classification: abnormal", 0, "normal"),
    ("resource leak", 8, "Remote Code Execution"),
    ("no idea", 10, "unknown"),
    ("final answer: xss", 4, "Cross-site Scripting"),
    (None, 10, "unknown"),
]


def test_label_extraction(frame):
    df = frame([(k, a) for k, (a, _, _) in enumerate(LABELS)], "k int, a string").withColumn("y", X.label_id(F.col("a"))).withColumn("n", X.label_name(F.col("y")))
    assert [(r.y, r.n) for r in df.orderBy("k").collect()] == [(y, n) for _, y, n in LABELS]
    assert df.filter("k = 2").select(X.label_id(F.col("a"), strict=True).alias("y")).first().y == 10


def test_prompt_pieces(value):
    assert value(X.after_last(F.lit("a Final Answer: b Final Answer: c \n"), "Final Answer:")) == "c"
    p = value(X.split_prompt(F.lit("sys\n# Input request\nx")))
    assert (p.system, p.user) == ("sys\n", "# Input request\nx")
    assert value(X.filled(F.lit("{a}-{b}"), a=F.lit("1"), b=F.lit(None).cast("string"))) == "1-"


def test_lag_and_sigmoid(value):
    assert [value(X.lag_of(F.lit(10), F.lit(c))) for c in (4, -1001, 10)] == [5, 0, 0]
    assert value(X.sigmoid(F.lit(-710.0))) == 0.0 and value(X.sigmoid(F.lit(0.0))) == 0.5
    low = structure.is_anomalous
    assert [value(low(F.lit(x))) for x in (-2.1972, -2.1973, -800.0)] == [False, True, True]
    assert value(low(F.lit(-800.0), compat=True)) is False


def test_identifiers_round_trip(value):
    assert value(X.decode_identifier(X.encode_identifier(F.lit("GET|a/b|x")))) == "GET|a/b|x"
    assert value(X.encode_identifier(F.lit("GET|a/b"))) == "GET__PIPE__a__SLASH__b"


def test_subsequences():
    assert arrow.common_subsequence("abcmnxyz", "abopcxyz") == "ab c xyz"
    assert arrow.common_of(["<script>alert(1)</script>", "<script>alert(22)</script>"]) == "<script>alert( )</script>"
    assert arrow.common_of(["One"]) == "One" and arrow.common_of([]) == ""


def test_signature(frame):
    df = frame([("<script>alert( )</script>",), ("' or 1=1--",), ("%27 UNION x",), ("/",), (" ",)], "c string").select(X.signature_of(F.col("c")).alias("s"))
    assert [r.s for r in df.collect()] == [r"<script>alert\(.*\)</script>", r"'.*or.*1=1\-\-", ".*.*UNION.*x", None, None]


def test_normaliser():
    config = arrow.NormaliserConfig(replacements={r"\b[0-9]+\b": "__pnum__", "abc": ["__x__", ["id"]]}, known_values={"lang": "en"})
    assert arrow.request_tokens("/Index.php?id=abc&n=12&lang=zz&id=2", config) == ["index", ".", "php", "id", "__x__", "n", "__pnum__", "lang", "en"]
    assert arrow.request_tokens("/go?u=http://evil.example/x&q=a%26b%3D1", config) == ["go", "u", "__http__", "q", "b", "__pnum__"]
    assert arrow.request_tokens("/a?x=????????&y=<b>", config) == ["a", "x", "y", "<", "b", ">"]


def test_bodies():
    assert arrow.unescape(r"aA\ud800") == "aA�"
    b = "-" * 29 + "1"
    body = "\r\n".join([b, 'Content-Disposition: form-data; name="a"', "", "x=1&y=2", "second line", b, 'Content-Disposition: form-data; name="b"', "", "plain", b + "--"])
    assert arrow.multipart_values(body) == ["x=1", "y=2", "", "", "plain"]
    assert arrow.multipart_values("") == []


def test_model_parts(frame):
    b = "-" * 29 + "1"
    multi = "\r\n".join([b, 'Content-Disposition: form-data; name="a"', "", "x=1&y=2", b + "--"])
    df = frame([(k, x) for k, x in enumerate([multi, "a=\\u0041&b=2", "{a:1, b:2}", "other text", None])], "k int, b string")
    got = df.select("k", arrow.model_parts(F.lit("POST"), F.lit("/p/q?z=1"), F.col("b")).alias("p")).orderBy("k").collect()
    assert [r.p[4:] for r in got] == [["x=1", "y=2"], ["a=A", "b=2"], ["a:1", "b:2"], [], []]
    assert got[0].p[:4] == ["POST", "/p", "/q", "z=1"]


def test_hash_has_a_separator(value):
    assert value(X.row_hash(F.lit("ab"), F.lit("c"))) != value(X.row_hash(F.lit("a"), F.lit("bc")))


def test_forms(frame):
    df = frame([("a=1",), ("é.%+=x y",), ("{a=1",), ("",), ("-" * 29 + "x",)], "b string").select(X.is_form(F.col("b")).alias("f"), X.is_multipart(F.col("b")).alias("m"))
    assert [(r.f, r.m) for r in df.collect()] == [(True, False), (True, False), (False, False), (False, False), (False, True)]


def test_threshold_is_the_logarithm():
    assert math.isclose(math.log(0.1 / 0.9), -2.1972245773, abs_tol=1e-9)


def test_canonical_url(value):
    assert value(X.canonical_url(F.lit("a%2fb c?z=1&a=%c3#f"), "http://Host.example/")) == "http://host.example/a%2Fb%20c?a=%C3&z=1"
    assert value(X.canonical_url(F.lit("/x;p?"), "http://h")) == "http://h/x;p"
    assert value(X.canonical_url(F.lit("//H?b&a%"))) == "//h/?a%&b"


def test_parameter_names(frame):
    got = frame([("id",), ("a$b",), ("",), (None,)], "c string").select(X.is_parameter_name(F.col("c")).alias("v")).collect()
    assert [r.v for r in got] == [True, False, False, False]
