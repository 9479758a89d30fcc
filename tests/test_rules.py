"""Numerals, chunk plans on pages, nested JSON and damage reports against plain versions of their rules."""

import json
import random
import re
import unicodedata

from pyspark.sql import functions as F

from quire.functions import boundaries, numerals
from quire.operators import chunk, clean
from quire.sources import json_text

DIGITS, UNITS = "零一二三四五六七八九", ("", "十", "百", "千")


def chinese(n):
    """A number below 10^12 as it is written."""
    if n == 0:
        return "零"
    out, gap = "", False
    for power, name in ((10**8, "亿"), (10**4, "万"), (1, "")):
        part, n = divmod(n, power)
        if not part:
            gap = gap or bool(out)
            continue
        body = ""
        for k in (3, 2, 1, 0):
            d = part // 10**k % 10
            if d:
                body += ("零" if (body and body[-1:] not in ("", "零") and part // 10 ** (k + 1) % 10 == 0) else "") + DIGITS[d] + UNITS[k]
        lead = "零" if out and (gap or part < 1000) else ""
        out, gap = out + lead + body + name, False
    return out


def test_chinese_numerals_are_read_as_written(spark):
    rng = random.Random(6)
    numbers = [*range(0, 130), *(rng.randrange(10 ** rng.randint(2, 12)) for _ in range(400))]
    rows = spark.createDataFrame([(n, chinese(n)) for n in numbers], "n long, t string")
    assert rows.filter(~numerals.chinese_to_int(F.col("t")).eqNullSafe(F.col("n"))).collect() == []
    wrong = ["万", "一二", "零零", "十十", "一百千", "一万亿", "零一", "1五", "一亿一亿一亿", "", " ", "一a"]
    right = {"十": 10, "十五": 15, "拾": 10, "一万亿": None, "3万": 30_000, "一百零": 100, "0十": 0, "零": 0, "洞": 0, "二万零三十": 20_030, "１２": 2}
    for text in wrong:
        right[text] = None
    right["１２"] = None  # two digits side by side are no Chinese numeral
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in right], "t string").select("t", numerals.chinese_to_int(F.col("t")).alias("v")).collect()}
    assert got == right


def pages(text, window, fits):
    """Chunks of pages by the rule itself: of each kind of place those that still fit, one after the other."""
    spans = boundaries.protected_spans(text)
    held = [any(a <= i < b for a, b in spans) for i in range(len(text))]
    quoted = [h or any(m.start() <= i < m.end() and m.end() - m.start() <= 300 for m in re.finditer(boundaries.QUOTATION, text)) for i, h in enumerate(held)]
    runs = lambda p: {m.end() for m in re.finditer(p, text) if not any(held[m.start() : m.end()])}
    spaces = {m.end() for m in re.finditer(r"\s+", text) if not held[m.start()]}
    outside = lambda c: c == len(text) or not (quoted[c - 1] and quoted[c])
    clauses = runs(boundaries.CLAUSE)
    out, start = [], 0
    while start < len(text):
        fine = lambda c, start=start: fits(text[start:c].strip())
        cut = len(text) if len(text) - start <= window and fine(len(text)) else None
        for places in (runs(boundaries.ENDING), set(filter(outside, clauses)), clauses, set(filter(outside, spaces)), spaces):
            if cut is None:
                able = []
                for c in sorted(c for c in places if start < c <= start + window):
                    if not fine(c):
                        break
                    if text[c:].lstrip()[:1] not in tuple(boundaries.LOOSE):
                        able.append(c)
                cut = able[-1] if able else None
        if cut is None:
            cut = next(c for c in range(min(start + window, len(text)), start, -1) if fine(c) and not held[c - 1] and (c == len(text) or not unicodedata.combining(text[c])))
        piece = text[start:cut].strip()
        if boundaries.spoken(piece):
            out.append(piece)
        elif piece and out:
            out[-1] += piece
        start = cut
    return out


def test_pages_end_at_the_farthest_place_that_fits():
    rng = random.Random(12)
    bits = ["Anh đi", ". ", "! ", ", ", " ", "“Có mà.” ", "3.14", "\n", "…", "(x) ", "từ dài quá", "» ", "câu "]
    budget, same = chunk.PageBudget(columns=20, lines=5), 0
    for _ in range(60):
        text = "".join(rng.choice(bits) for _ in range(90))
        try:
            got = [c[0] for c in boundaries.plan_chunks(text, 300, 150, fits=budget.fits)]
        except boundaries.CannotCut:
            continue
        assert got == pages(text, 150, budget.fits)
        same += 1
    assert same > 40


def test_halves_are_nearest_the_middle():
    assert boundaries.half_split("Một câu. Hai câu dài hơn, ba.") == ("Một câu.", "Hai câu dài hơn, ba.")
    assert boundaries.half_split("một hai, ba bốn năm") == ("một hai,", "ba bốn năm")
    assert boundaries.half_split("abcdef") == ("abc", "def") and boundaries.half_split("a") == ("a", "")
    assert boundaries.half_split("Chương 12 mở đầu") == ("Chương 12 mở đầu", "") and boundaries.half_split("a.b@c.vn") == ("a.b@c.vn", "")


def test_json_of_any_depth(spark):
    deep = value = {"text": "đáy"}
    for k in range(300):
        value = [value] if k % 2 else {"data": value}
    rows = spark.createDataFrame([(json.dumps(value),), (json.dumps({"chapters": [{"number": 2, "title": "T", "content": "a", "raw": "b"}], "meta": "m"}),)], "json string")
    got = json_text.unwrap_json(rows).collect()
    assert got[0]["text"] == deep["text"] and got[0]["blocks"][0]["path"].count("[0]") == 150
    assert got[1]["text"] == "Chương 2: T\na" and [(a["action"], a["key"]) for a in got[1]["artifacts"]] == [("skipped", "raw"), ("used", "content"), ("skipped", "meta")]


def test_damage_is_told_by_place(spark):
    text = "ab\ncÃ© ï»¿x\ufffd\r\nðŸÃ© á»\x80 Ã©"
    rows = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id long, text string")
    found = clean.suspicious(rows)
    got = [(r.rule, r.value, r.start, r.line) for r in found.orderBy("start", F.length("value")).collect()]
    want = []
    for name, p in (*clean.MOJIBAKE, ("replacement-char", r"\x{FFFD}")):
        p = re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), p)
        want += [(name, m.group(), m.start(), text[: m.start()].count("\n") + 1) for m in re.finditer(p, text)]
    assert sorted(got) == sorted(want) and ("latin1-utf8", "Ã©", 4, 2) in got and len({g[2] for g in got}) >= 5
    report = {(r.rule, r.value): (r.n, len(r.contexts)) for r in clean.suspicious_report(found).collect()}
    assert report["latin1-utf8", "Ã©"] == (3, 1)  # the whole text is the context of each
    told = clean.sanitize_warnings(clean.sanitize(spark.createDataFrame([(1, "漢字 x。")], "doc_id long, text string")), found).collect()
    assert ("detected_cjk_chars", 2, "kept") in [tuple(r)[1:] for r in told] and any(r.code == "utf8-bom" and "line 2, char 5" in r.detail for r in told)


def test_only_words_that_may_hold_a_token_are_looked_through(monkeypatch):
    """The same tokens as by a search through the whole text, from a small part of it."""
    import random
    import re

    from quire.functions import boundaries

    class Seen:
        def __init__(self, pattern):
            self.pattern, self.chars = pattern, 0

        def finditer(self, text, begin=0, end=None):
            end = len(text) if end is None else end
            self.chars += end - begin
            return self.pattern.finditer(text, begin, end)

    seen = Seen(boundaries._TOKEN)
    monkeypatch.setattr(boundaries, "_TOKEN", seen)
    text = "Đêm ấy trời mưa. " * 1000 + "xem https://a.vn/x....y, rồi " + "Không ai nói gì! " * 1000
    assert [text[a:b] for a, b in boundaries.protected_spans(text)] == ["https://a.vn/x....y"]
    assert seen.chars < 100
    every = "|".join(re.escape(a) for a in sorted(boundaries.ABBREVIATIONS, key=len, reverse=True))
    bits = ["https://a.vn/x....y,", "www.b/c.", "a.b@c.org", " ", "\n", "\u2028", "3.14", "٣.٤", "k:v/x", "C:\\x", '{"a": 1}', "shop.Com", "a.info", "U.S.A.", "dr. ", "Thſ.", "ThſS.", "mr", "é", "。", "word", "..."]
    rnd = random.Random(3)
    for _ in range(2000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))
        found = sorted(set(boundaries.protected_spans(text)) - set(boundaries._objects(text)))
        whole = []
        for m in seen.pattern.finditer(text):
            token = m.group()
            whole.append((m.start(), m.start() + len(token.rstrip(boundaries.TRAILING) if "://" in token or "\\" in token or token[:4].lower() == "www." else token)))
        whole += (m.span() for pattern in (re.compile(rf"(?<!\w)(?:{every})(?!\w)", re.I), re.compile(boundaries.INITIALS)) for m in pattern.finditer(text))
        assert found == sorted(set(whole) - set(boundaries._objects(text))), text


def test_texts_without_anything_to_mend_are_not_rewritten(monkeypatch):
    from quire.functions import sanitizing
    from quire.operators import clean

    tried = []
    sub = sanitizing.Text.sub
    monkeypatch.setattr(sanitizing.Text, "sub", lambda self, pattern, *more, **over: tried.append(pattern.pattern) or sub(self, pattern, *more, **over))
    one = sanitizing.Sanitizer(clean.SanitizeOptions(), clean.FIXED, {"urls": "", "emails": ""}, clean.sanitize_counters())
    assert one("Đêm ấy trời mưa. Không ai nói gì!")[0] == "Đêm ấy trời mưa. Không ai nói gì!"
    assert sanitizing.python_pattern(clean.FIXED["spaces"]) not in tried
    assert sanitizing.python_pattern(clean.FIXED["line_end"]) not in tried


def test_marks_after_a_full_chunk_take_its_last_word_along():
    import random

    from quire.functions import boundaries

    bare = lambda t: "".join(t.split())
    assert [c[0] for c in boundaries.plan_chunks("ab " * 29 + "cd. ****", 90, 2000)] == ["ab " * 28 + "ab", "cd.****"]
    rnd = random.Random(2)
    for _ in range(3000):
        text = "".join(rnd.choice(("lời", "ab", "dài quá", "xin chào bạn")) + rnd.choice((" ", ", ", ". ", "*** ", " %%% ", " | ", "&&&\n", " $$ ")) for _ in range(rnd.randint(1, 40))) + rnd.choice(("", " ***", " | |", "&&&&&&"))
        chunks = [c[0] for c in boundaries.plan_chunks(text, 30, 2000)]
        assert all(len(c) <= 30 and boundaries.spoken(c) for c in chunks), text
        assert bare("".join(chunks)) == bare(text), text
