import pytest
from pyspark.sql import functions as F

from bytefold.operators import detection, paths, text

MARKDOWN = {
    "# Title\ntext": "Title\ntext\n",
    "**b** and _i_": "b and i\n",
    "* item": " item\n",
    "- item": "item\n",
    "- ": "- \n",
    "[a](u) [b](v)": "a b\n",
    "[x] [a](u)": "[x] [a](u)\n",
    "  # no": "  # no\n",
    "#no": "#no\n",
    "```py\ncode```\nz": "py\ncode\nz\n",
    "```a```xy```b": "axy```b\n",
    "snake_case": "snakecase\n",
    "": "",
    "a\n\nb\n": "a\n\nb\n",
}
CSV = {
    "a,b,": ["a", "b", ""],
    '"a""b",c': ['a"b', "c"],
    '"a"b,c': ["ab", "c"],
    'a"b,c': ['a"b', "c"],
    "": [""],
    '"open,x': ["open,x"],
    '""x,""': ["x", ""],
    "a\rb,c": ["ab", "c"],
    ",,": ["", "", ""],
}


def test_strip_markdown(spark):
    df = spark.createDataFrame([(k, v) for k, v in MARKDOWN.items()], "t string, want string")
    for r in df.withColumn("got", text.strip_markdown("t")).collect():
        assert r["got"] == r["want"], r["t"]


def test_csv(spark):
    df = spark.createDataFrame([(k, v) for k, v in CSV.items()], "t string, want array<string>")
    for r in df.withColumn("got", text.csv_fields("t")).collect():
        assert r["got"] == r["want"], r["t"]
    fields = ["plain", 'q"q', "a,b", "x\ny", ""]
    df = spark.createDataFrame([fields], "a string, b string, c string, d string, e string")
    line = df.select(text.csv_line([F.col(c) for c in "abcde"]).alias("l")).withColumn("f", text.csv_fields("l")).first()
    assert line["l"] == 'plain,"q""q","a,b","x\ny",' and line["f"] == fields
    rows = text.csv_records(spark.createDataFrame([(1, "a,b\r\nc\n")], "id int, c string"), "c").collect()
    assert [(r["row_no"], r["fields"]) for r in rows] == [(0, ["a", "b"]), (1, ["c"])]


def test_ini_round_trip(spark):
    content = "; note\na = 1\n[s]\nx=\"q\"\ny = 2\ny = 3\n[bad\n[t]\nz = 'w'\n"
    df = spark.createDataFrame([(1, content)], "id int, c string")
    e = text.ini_entries(df, "id", "c")
    got = {(r["section"], r["name"]): r["value"] for r in e.collect()}
    assert got == {("", "a"): "1", ("s", "x"): "q", ("s", "y"): "3", ("t", "z"): "w"}
    out = text.ini_text(e, "id").first()["content"]
    assert out == "a = 1\n\n[s]\nx = q\ny = 3\n\n[t]\nz = w\n"


@pytest.mark.parametrize(
    ("src", "want"),
    [('{"b": 2e3, "a": [1, -0.0, 1.5]} tail', '{"a":[1,0,1.5],"b":2000}'), ('{"a":1,"a":2}', '{"a":2}'), ("1e999", None), ("[", None), ("1e15", "1e+15"), ("[]", "[]"), ('"\\ud83d\\ude00"', '"\U0001f600"')],
)
def test_json(src, want):
    assert text.canonical_json(src) == want


def test_paths_and_detection(spark):
    rows = [("a.tar.gz", "gz", "a.tar.txt"), ("a.b/c", "", "a.b/c.txt"), ("x.PNG", "png", "x.txt"), ("http://h.org/p", "", "http://h.org/p.txt"), ("d\\e.f", "f", "d\\e.txt")]
    df = spark.createDataFrame(rows, "p string, e string, c string")
    for r in df.select("*", paths.extension(F.col("p")).alias("x"), paths.change_extension(F.col("p"), F.lit("txt")).alias("y"), paths.filename(F.col("p")).alias("n"), paths.directory(F.col("p")).alias("d")).collect():
        assert (r["x"], r["y"]) == (r["e"], r["c"])
        assert r["d"] == "." or r["p"] in (f"{r['d']}/{r['n']}", f"{r['d']}\\{r['n']}")
    b = [(bytes.fromhex("89504E47"), "png"), (b"BM text", "bmp"), (b"solid x", "stl"), (b"a;b;c\nd", None), (b"", None)]
    df = spark.createDataFrame(b, "c binary, e string")
    for r in df.select("*", detection.by_magic("c").alias("m"), detection.is_csv("c").alias("csv"), detection.delimiter("c").alias("d"), detection.is_text("c").alias("t"), detection.is_json("c").alias("j")).collect():
        assert r["m"] == r["e"] and r["csv"] == (r["c"] == b"a;b;c\nd") and not r["j"]
        if r["csv"]:
            assert r["d"] == ";" and r["t"]
    assert len(detection.EXTENSIONS) == 85 and len(detection.MAGIC) == 12
    assert detection.conversions(spark).count() == 36 + 36 + 4 + 4 + 12
