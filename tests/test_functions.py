"""Scalar functions on edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import numerals, text
from quire.operators import clean
from quire.sources.json_text import unwrap_json


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(("token", "value"), [("十五", 15), ("九十八", 98), ("一百零五", 105), ("三千二百", 3200), ("二十万", 200000), ("一亿零五十", 100000050), ("零", 0), ("一二", None), ("零零", None), ("零五", None), ("万", None), ("百", None), ("十百", None), ("一百二十三千", None), ("12", 12), ("１，２３４", 1234), ("99999999999999999999", None), ("", None), (None, None), ("x", None), ("两千", 2000)])
def test_number_tokens(spark, token, value):
    assert one(spark, numerals.parse_number(F.col("t")), t=token) == value


@pytest.mark.parametrize(("token", "value"), [("IV", 4), ("mcmxciv", 1994), ("IIII", 4), ("", None), ("A", None), (None, None)])
def test_roman(spark, token, value):
    assert one(spark, numerals.roman_to_int(F.col("t")), t=token) == value


def test_headers(spark):
    assert one(spark, numerals.format_header(F.col("n"), F.col("t")), n=7, t=" a ") == "Chương 7: a"
    assert one(spark, numerals.format_header(F.col("n"), F.col("t"), zero_pad=3), n=12345, t=None) == "Chương 12345"
    assert one(spark, numerals.clean_header(F.col("t")), t="## > Chương 1 ==*") == "Chương 1"
    assert one(spark, numerals.clean_header(F.col("t")), t="-# x") == "# x"  # marks are stripped kind by kind


@pytest.mark.parametrize(("raw", "clean"), [("a  b", "a b"), ("a , b", "a, b"), ("( a )", "(a)"), ("a\r\nb\rc", "a\nb\nc"), ("a\n\n\n\nb", "a\n\nb"), ("\n a \n", " a"), ("x \n.", "x."), ("", ""), (None, None)])
def test_spacing(spark, raw, clean):
    assert one(spark, text.normalize_spacing(F.col("t")), t=raw) == clean


def test_brackets_quotes_endings(spark):
    assert one(spark, text.strip_pairs(F.col("t")), t="((a)) [b] 【c") == "(a) b 【c"
    assert one(spark, text.strip_pairs(F.col("t"), mode="remove"), t="((a)) [b] 【c") == "a b c"
    assert one(spark, text.quotes_to_single(F.col("t"))[0], t="“a” „b‟ \"c＂") == "'a' 'b' 'c'"
    assert one(spark, text.quotes_to_single(F.col("t"))[1], t="“a” „b‟ \"c＂") == 6
    assert one(spark, text.end_sentences(F.col("t"))[0], t="one\ntwo.\n\nx\n中文字\n—\nend,") == "one.\ntwo.\n\nx\n中文字.\n—\nend,"
    assert one(spark, text.restore_newlines(F.col("t"))[0], t=r"a\r\nb\nc\rd C:\notes") == "a\nb\nc\nd C:\notes"


def test_languages_and_names(spark):
    for raw, told in (("流民不可怕", "zh"), ("流 abc def", "mixed"), ("abc", "vi"), ("123", "unknown"), ("", "unknown")):
        assert one(spark, text.language_of(F.col("t")), t=raw) == told
    assert one(spark, text.slug(F.col("t")), t=' a/b: "c" ') == "a_b_c"
    assert one(spark, text.slug(F.col("t")), t="..") == "untitled"
    names = ["Chap 10", "chap 2", "Chap 1", "b", "a2", "a10"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n"))).collect()
    assert [r[0] for r in got] == ["a2", "a10", "b", "Chap 1", "chap 2", "Chap 10"]


def cleaned(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [r["text"] for r in clean.sanitize(rows, clean.SanitizeOptions(**options)).orderBy("i").collect()]


def test_sanitizing(spark):
    pairs = [
        ("# Tiêu đề\n\n“Không!!” , anh nói...\n- mục **đậm** [a](b)\n> trích", "Tiêu đề\n\n'Không!', anh nói…\n— mục đậm a (b)\ntrích"),
        ("a\u200bb\u0007c क\u094d\u200dष x\u200dy", "abc क\u094d\u200dष xy"),
        ("e\u0301 &amp;amp; &eacute; &nosuch;", "é & é &nosuch;"),
        ("xem https://x....y/z, nhé a.b@c.org", "xem, nhé a.b@c.org"),
        ("<p>một</p>hai<br/>ba <test> 1 < 2 <!-- x --> <!-- y", "một\nhai\nba <test> 1 < 2 <!-- y"),
        ("chapter_id=5\nđoạn\nsource_url = x", "đoạn"),
        ("một.Hai,ba 3.14 v1.2.3 12:30", "một. Hai, ba 3.14 v1.2.3 12:30"),
        ("*a* __b__ `c` snake_case 2*3 **x", "a b c snake_case 2*3 **x"),
        ("•mục\n● xong!\n***\n\n\n\n* * *", "mục.\nxong!\n\n* * *"),
        ("gì?!?! a ! ! b。。 c", "gì?! a! b. c"),
        ("Chương 1 mở.Đêm ấy", "Chương 1 mở\n\nĐêm ấy"),
        ("Ã© giữ\u00a0nguyên \ufffd 😀", "Ã© giữ nguyên \ufffd"),
        ('{"a": "b..c"} "d"', '{"a": "b..c"} \'d\''),
        ("", ""),
        (None, ""),
    ]
    got = cleaned(spark, [a for a, _ in pairs])
    assert got == [b for _, b in pairs]
    assert cleaned(spark, got) == got
    assert cleaned(spark, ["a https://x.vn. b@c.vn"], links="replace", mails="remove") == ["a [đường dẫn]."]
    assert cleaned(spark, ["Một. Hai! Ba"], sentence_per_line=True) == ["Một.\nHai!\nBa"]
    assert cleaned(spark, ["  x..  "], enabled=False) == ["  x..  "]
    for wrong in ({"links": "x"}, {"blank_lines": 11}):
        with pytest.raises(ValueError):
            clean.SanitizeOptions(**wrong)


def test_sanitizing_mixtures(spark):
    rng = random.Random(17)
    bits = ["Anh nói", "“Không”", "...", "!!", "?!", " , ", "\n\n\n", "<b>x</b>", "<!-- y -->", "# Tiêu đề", "- mục", "> trích", "\u200b", "\x07", "  ", "3.14", "https://a.vn/x", "。", "--- "]
    for t in cleaned(spark, ["".join(rng.choice(bits) for _ in range(20)) for _ in range(200)]):
        assert not any(x in t for x in ("  ", "\n\n\n", "\x07", "\u200b", "<b>", "“", "...", "。"))


def test_suspicious(spark):
    rows = spark.createDataFrame([(1, "ab\ncÃ© ï»¿x\ufffd"), (2, "Ân"), (3, None)], "doc_id long, text string")
    got = [tuple(r)[1:6] for r in clean.suspicious(rows).orderBy("start").collect()]
    assert got == [("latin1-utf8", "Ã©", 4, 2, 2), ("utf8-bom", "ï»¿", 7, 2, 5), ("replacement-char", "\ufffd", 11, 2, 9)]


def test_prepared_chapters(spark):
    rows = spark.createDataFrame([(1, "Chương 1 mở.Đêm ấy", "“một”..")], "number long, header string, text string")
    r = clean.prepare_chapters(rows, clean.CleanOptions(rules=[clean.Rule("một", "hai", regex=False)])).first()
    assert (r["header"], r["text"], r["double_quotes_normalized"], r["custom_rule_hits"]) == ("Chương 1 mở", "Đêm ấy\n\n'hai'.", 2, 1)


def test_json(spark):
    import json

    values = [{"data": [{"title": "T", "number": 3, "text": "a", "translated": "b"}, "c"]}, {"meta": "m", "x": {"noi_dung": "d", "raw": "long raw"}}, [1, "e"], {"name": "N", "body": "Chương 9 f"}]
    rows = spark.createDataFrame([(json.dumps(v),) for v in values] + [("plain",), ("12",), (None,), ('{"a": "g"} junk',)], "json string")
    got = unwrap_json(rows).select("text", "is_json").collect()
    assert [r["text"] for r in got] == ["Chương 3: T\nb\n\nc", "d", "e", "Chương 9 f", "plain", "12", "", "g"]
    assert [r["is_json"] for r in got] == [True] * 4 + [False] * 3 + [True]
    first = unwrap_json(rows, prefer_translation=False, headers=False).first()
    assert first["text"] == "a\n\nc" and {(a["key"], a["action"]) for a in first["artifacts"]} == {("text", "used"), ("translated", "skipped")}


def test_cleaning_reads_a_text_once_for_each_step(spark):
    import contextlib
    import io

    rows = spark.createDataFrame([(1, "a b\x1c ,c .\r\n\r\n\r\n“x” ‘y’ «z»„q‟ ((a)) 5 & 6 ＆ 100%\n\nend 　"), (2, None), (3, ""), (4, "\n\n")], "id long, text string")
    symbols = {"&": " và ", "%": "p", "100": "c"}  # of which one word is as long as its symbol
    made = clean.clean(rows, clean.CleanOptions(symbols=symbols, endings=True))
    got = {r.id: r for r in made.collect()}
    assert got[1].text == "a b,c.\n\nx y zq (a) 5 và 6 ＆ cp.\n\nend."
    assert (got[1].control_chars, got[1].quotes_removed, got[1].bracket_pairs_removed, got[1].symbols_replaced, got[1].periods_added) == (1, 4, 3, 3, 2)
    assert all(got[i].text == "" and got[i].before_chars == (2 if i == 4 else 0) for i in (2, 3, 4))
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        made.explain()
    assert "translate(" not in plan.getvalue()
    for chars in (text.REMOVED_QUOTES, "\"'", "“", "\\]^-[", "😀a"):
        own = f"x{chars}y[]^-z😀“"
        assert spark.range(1).select(F.regexp_replace(F.lit(own), text.any_of(chars), "")).first()[0] == "".join(c for c in own if c not in chars)
