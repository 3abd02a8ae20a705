import pytest
from pyspark.sql import functions as F

from textloom.functions import ids
from textloom.functions import text as T
from textloom.sources import files


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("text, want", [("Ａbc  DEF", "abc def"), ("كتاب ي", "کتاب ی"), ("می‌روم", "می روم"), ("۱۲۳ ٤", "123 4"), ("Straße", "strasse"), ("کِتاب ـ", "کتاب"), ("", "")])
def test_fold(spark, text, want):
    assert T.fold(text) == want
    assert one(spark, T.normal_form, text) == want


def test_norm_equals_fold_on_plain_text(spark):
    for text in ("Straße  ÉA\n x", "كتاب۱", "abc"):
        assert one(spark, T.norm, text) == T.fold(text)


def test_variants_own_first(spark):
    got = one(spark, T.variants, "کی 1")
    assert got[0] == "کی 1" and "كي ١" in got and len(got) == len(set(got)) == 6


def test_stem(spark):
    assert one(spark, T.stem, "کتابها") == "کتاب"
    assert one(spark, T.stem, "ها") == "ها"


def test_clean_query(spark):
    assert one(spark, T.clean_query, 'a\t"b\nc') == "a b c"
    assert one(spark, T.clean_query, 'a "b"') == 'a "b"'


def test_hits_lines_context(spark):
    text = "aXb\ncXXd"
    assert one(spark, lambda c: T.hit_count(c, F.lit("X")), text) == 3
    assert one(spark, lambda c: T.line_of(c, F.lit(6)), text) == 2
    assert one(spark, lambda c: T.context(c, F.lit(2), F.lit(1), 1, 2), text) == "aXb "


def test_budget(spark):
    assert one(spark, T.estimate_tokens, "abcdé") == 2
    assert one(spark, lambda c: T.fits_budget(c, 1), "abcdé") is False


def test_front_matter_first_key_wins(spark):
    text = "---\nid: a\nid: b\nlist:\n  - x\ntitle: T: u\n---\nbody"
    assert one(spark, T.front_matter, text) == {"id": "a", "list": "", "title": "T: u"}
    assert one(spark, T.strip_front_matter, text) == "body"


def test_code_links_quotes(spark):
    assert one(spark, T.strip_code, "a `x` b\n```\n[[no]]\n```\n[[yes|Y]]").count("[[") == 1
    assert one(spark, T.wikilinks, "[[a]] [[b|c]] [[d#e]]") == ["a", "b", "d"]
    assert one(spark, T.quotes, 'x "a quoted passage that is long" y') == ["a quoted passage that is long"]


def test_html(spark):
    html = "<h1>A</h1><script>x</script><p>b &amp; c</p><ul><li>d</li></ul><table><tr><th>h</th></tr><tr><td>1</td></tr></table><footer>z</footer>"
    assert files.to_markdown(html) == "# A\n\nb & c\n\n- d\n\n| h |\n| --- |\n| 1 |"
    assert one(spark, T.strip_tags, "<p>a<br>b&nbsp;&lt;c</p><style>q</style>") == "a b <c"
    assert files.to_html("# A\n- b\n\nc") == "<h1>A</h1>\n<ul>\n<li>b</li>\n</ul>\n<p>c</p>"


def test_mojibake(spark):
    assert one(spark, T.is_mojibake, "Ã©tÃ©") is True
    assert one(spark, T.is_mojibake, "été") is False


def test_redact_and_slug(spark):
    assert one(spark, T.redact, "token = abc and /home/x/y") == "token=[redacted] and [path]"
    assert one(spark, T.slug, "Été à Paris!") == "ete-a-paris"
    assert one(spark, T.slug, "Ångström č Ž ő Đ e\u0301") == "angstrom-c-z-o-e"


def test_canonical_json(spark):
    got = one(spark, lambda c: ids.canonical_json(b=ids.json_string(c), a=F.lit("1")), 'x"\n')
    assert got == '{"a":1,"b":"x\\"\\n"}'


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    df = files.json_lines(spark, str(p), "a long").cache()
    assert df.where("_corrupt is not null").count() == 1 and df.where("a is not null").count() == 2
    with pytest.raises(Exception):
        files.json_lines(spark, str(p), "a long", strict=True).collect()


def test_text_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("hello")
    (tmp_path / "a" / "y.txt").write_text("no")
    assert [r.text for r in files.text_files(spark, str(tmp_path)).collect()] == ["hello"]
