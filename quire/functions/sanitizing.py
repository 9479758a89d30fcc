"""One pass that makes a text ready for reading aloud: a helper that runs inside tasks, a text at a time.

A text is rewritten in place by lists of edits (begin, end, new). What must stay as it is, is
held by spans of the text itself: every list of edits leaves out those that touch a held span,
and moves the spans along. Nothing stands in for anything, so a text may hold any characters.

Steps whose characters a text doesn't have are passed over. Everything is linear in the text's length.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable
from functools import lru_cache

from quire.functions import boundaries as B
from quire.functions.text import DOUBLE_QUOTES

Edit = tuple[int, int, str]


def python_pattern(pattern: str) -> str:
    """An expression of the shared constants, which name characters as \\x{...}, for this module's engine."""
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)


# What a text must have for a step to change it or count anything; each is looked for before the step's own expression.
_DAMAGED = re.compile("[ÃÄÅÆÂâïð]|á»")
_PERIODS = re.compile(r"\.[ \t]*\.")
_SPACE_BEFORE = re.compile(r"[,.;:!?…%)\]}”’»](?<=[ \t].)")
_TWO_SPACES = re.compile("   *")
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in "\n "]
_LINK_HINT, _MAIL_HINT = re.compile(r"[:.](?:(?<=:)(?=//)|(?<=[Ww]{3}\.))"), re.compile("@")
#: Bytes of UTF-8 that no step is told by: letters of ASCII, blanks, first bytes of letters up to U+01BF, and bytes inside of characters.
_PLAIN = bytes(b for b in range(256) if chr(b).isalpha() and b < 128 or b == 32 or 0x80 <= b < 0xC0 or 0xC3 <= b <= 0xC6)


_E2 = re.compile(rb"\xe2..", re.S)


def _bytes(ascii_: bytes, *firsts: int | range, chars: str = "") -> frozenset[int | bytes]:
    """Characters of ASCII, first bytes of others but U+2000 to U+2FFF, and such characters."""
    return frozenset(ascii_).union(*(f if isinstance(f, range) else [f] for f in firsts), (c.encode() for c in chars))


def _range(first: int, last: int) -> str:
    return "".join(map(chr, range(first, last + 1)))


_CONTROL = _bytes(bytes({*range(32), 127} - {9, 10, 13}), 0xC2)
_INVISIBLE = _bytes(b"", 0xC2, 0xD8, 0xEF, chars="\u200b\u200e\u200f" + _range(0x202A, 0x202E) + _range(0x2060, 0x2069))
_PICTURE, _WIDE = _bytes(b"", 0xF0, chars="\u20e3" + _range(0x2600, 0x27BF)), _bytes(b"", 0xE3, 0xEF)
_OTHER_SPACE = _bytes(b"\t\v\f\r\x1c\x1d\x1e\x1f", 0xC2, 0xE3, chars="".join(c for c in _SPACES if "\u2000" <= c < "\u3000"))  # and U+1680
_DECORATION = _bytes(b"-*=~#_|", chars="–—■◆◇★☆█•●▪│")
_MARK, _MARK_OR_CLOSER = _bytes(b".,!?:;", chars="…"), _bytes(b".,!?:;%)]}", 0xC2, chars="…”’")
_TOKEN = _bytes(b":@.{,/-")
_DIGIT = _bytes(b"0123456789", 0xD9, 0xDB, 0xDF, 0xE0, 0xE1, 0xEA, 0xEF, 0xF0)
_FOUND = {
    "detected_cjk_chars": _bytes(b"", range(0xE3, 0xEA), 0xEF, 0xF0),
    "detected_other_script_chars": _bytes(b"", range(0xCD, 0xDC), 0xE0, 0xE1, 0xE3, range(0xEA, 0xEE)),
    "detected_cjk_punctuation": _bytes(b"", 0xE3),
    "detected_replacement_chars": _bytes(b"", 0xEF),
}


class Text:
    """A text with held spans (begin, end, whether it is damage), sorted and apart."""

    def __init__(self, text: str) -> None:
        self.text, self.spans = text, []
        self._of, self._seen, self.spaced = None, set(), None

    @property
    def seen(self) -> set[int | bytes]:
        """The text's bytes in UTF-8 but for _PLAIN, and its characters U+2000 to U+2FFF; looked up once until the text changes."""
        if self._of is not self.text:
            raw = self.text.encode("utf-8", "surrogatepass")
            self._of, self._seen = self.text, set(raw.translate(None, _PLAIN))
            if 0xE2 in self._seen:
                self._seen.update(_E2.findall(raw))
        return self._seen

    def has(self, some: frozenset[int | bytes]) -> bool:
        return not some.isdisjoint(self.seen)

    def hold(self, spans: Iterable[tuple[int, int, bool]]) -> None:
        """Hold further spans; those that overlap become one."""
        out: list[tuple[int, int, bool]] = []
        for a, b, damage in sorted([*self.spans, *spans]):
            if out and a < out[-1][1]:
                a, b, damage = out[-1][0], max(b, out[-1][1]), damage or out[-1][2]
                out.pop()
            if a < b:
                out.append((a, b, damage))
        self.spans = out

    def release(self) -> None:
        """Hold damage only."""
        self.spans = [s for s in self.spans if s[2]]

    def apply(self, edits: Iterable[Edit], *, over: bool = False) -> int:
        """Make edits, in order and apart; one that touches a held span is left out (over: it takes the span with it)."""
        text, spans = self.text, self.spans
        parts, kept, done, moved, k, n = [], [], 0, 0, 0, 0
        if not spans:
            for a, b, new in edits:
                parts += (text[done:a], new)
                done = b
            if parts:
                self.text = "".join([*parts, text[done:]])
            return len(parts) // 2
        for a, b, new in edits:
            while k < len(spans) and spans[k][1] <= a:
                kept.append((spans[k][0] + moved, spans[k][1] + moved, spans[k][2]))
                k += 1
            if k < len(spans) and spans[k][0] < b:
                if not over:
                    continue
                while k < len(spans) and spans[k][0] < b:
                    k += 1
            parts += (text[done:a], new)
            done = b
            moved += len(new) - (b - a)
            n += 1
        if n:
            kept += ((a + moved, b + moved, d) for a, b, d in spans[k:])
            self.text, self.spans = "".join([*parts, text[done:]]), kept
        return n

    def sub(self, pattern: re.Pattern, new: str | Callable[[re.Match], str | None], *, over: bool = False) -> int:
        """Replace matches; a function that gives None leaves one as it is."""
        if not self.spans:
            same = 0

            def given(m: re.Match) -> str:
                nonlocal same
                value = new(m)
                if value is None:
                    same += 1
                    return m[0]
                return value

            text, n = pattern.subn(new.replace("\\", r"\\") if isinstance(new, str) else given, self.text)
            if n > same:
                self.text = text
            return n - same
        if isinstance(new, str):
            return self.apply(((m.start(), m.end(), new) for m in pattern.finditer(self.text)), over=over)
        return self.apply(((m.start(), m.end(), value) for m in pattern.finditer(self.text) if (value := new(m)) is not None), over=over)

    def parted(self) -> tuple[Text, Text, list[bool]] | None:
        """Parts without and with held spans, each joined by U+0000 (which the text mustn't hold), and the order of both (true: held).

        Parts are cut between two letters or digits. None where nothing is held.
        """
        text, size = self.text, len(self.text)
        if not self.spans:
            return None
        cuts: list[list[int]] = []
        for a, b, _ in self.spans:
            low = cuts[-1][1] if cuts else 0
            if a >= low:
                while a > low and not (text[a - 1].isalnum() and text[a].isalnum()):
                    a -= 1
            while b < size and not (text[b - 1].isalnum() and text[b].isalnum()):
                b += 1
            if cuts and a <= low:
                cuts[-1][1] = max(low, b)
            else:
                cuts.append([a, b])
        order, parts, at = [], ([], []), 0
        spans, k, place = [], 0, 0
        for a, b in cuts:
            if at < a:
                order.append(False)
                parts[0].append(text[at:a])
            order.append(True)
            parts[1].append(text[a:b])
            while k < len(self.spans) and self.spans[k][0] < b:
                begin, end, damage = self.spans[k]
                spans.append((begin - a + place, end - a + place, damage))
                k += 1
            place += b - a + 1
            at = b
        if at < size:
            order.append(False)
            parts[0].append(text[at:])
        free, held = Text("\0".join(parts[0])), Text("\0".join(parts[1]))
        held.spans = spans
        return free, held, order

    def join(self, free: Text, held: Text, order: list[bool]) -> None:
        """Parts of parted, edited, as the text."""
        sides = iter(free.text.split("\0")), iter(held.text.split("\0"))
        parts, spans, k, place, at = [], [], 0, 0, 0
        for kept in order:
            part = next(sides[kept])
            if kept:
                while k < len(held.spans) and held.spans[k][0] < place + len(part):
                    begin, end, damage = held.spans[k]
                    spans.append((begin - place + at, end - place + at, damage))
                    k += 1
                place += len(part) + 1
            parts.append(part)
            at += len(part)
        self.text, self.spans = "".join(parts), spans

    def composed(self) -> str:
        """The text with what isn't held composed."""
        parts, at = [], 0
        for a, b, _ in self.spans:
            parts += (unicodedata.normalize("NFC", self.text[at:a]), self.text[a:b])
            at = b
        return "".join([*parts, unicodedata.normalize("NFC", self.text[at:])])


_RUN = {mark: re.compile(re.escape(mark) + "+") for mark in "*_`"}


def unpaired(text: str, mark: str) -> list[Edit]:
    """Edits that take away paired runs of a mark; runs between letters or digits and unpaired ones stay."""
    gone, opened, size = [], [], len(text)
    for m in _RUN[mark].finditer(text):
        begin, end = m.span()
        left, right = text[begin - 1] if begin else " ", text[end] if end < size else " "
        word = left.isalnum()
        if right.isalnum():
            if not word:
                opened.append((begin, end))
            continue
        at = begin
        if not left.isspace():  # may close what is open, as far as it is long enough
            while opened and opened[-1][1] - opened[-1][0] <= end - at:
                low, high = opened.pop()
                gone += ((low, high, ""), (at, at + high - low, ""))
                at += high - low
        if at == begin and not word and not right.isspace():
            opened.append((begin, end))
    return gone


def _entity(m: re.Match) -> str:
    """An entity decoded until nothing changes, so that one that decodes to another is, too."""
    before, now = "", m.group()
    while now != before:
        before, now = now, html.unescape(now)
    return now


@lru_cache(4096)
def _other_letter(c: str) -> bool:
    return c.isalpha() and "LATIN" not in unicodedata.name(c, "")


class Sanitizer:
    """The pass for given options and expressions (fixed: names to expressions in the shared dialect)."""

    def __init__(self, options, fixed: dict, labels: dict[str, str], counters: list[str]) -> None:
        self.options, self.labels, self.counters = options, labels, counters
        p = {name: re.compile(python_pattern(x)) for name, x in fixed.items() if isinstance(x, str)}
        p["blank_lines"] = re.compile(rf"\n{{{options.blank_lines + 2},}}")
        self.p = p
        self.any_quote = re.compile(f"[{re.escape(DOUBLE_QUOTES)}]")
        self.dotted = B.dotted(tuple(options.abbreviations))
        #: Of a text without these no technical token can hold a quotation mark.
        self.quoting = re.compile("[{" + re.escape(DOUBLE_QUOTES.replace('"', "").replace("“", "").replace("”", "")) + "]")
        self.quoted_short = any(self.any_quote.search(a) for a in options.abbreviations)
        self.wide = dict(zip(*fixed["wide"], strict=True))
        self.any_wide = re.compile(f"[{fixed['wide'][0]}]")
        self.blocks = re.compile(fixed["blocks"], re.I)
        self.block: dict[str, str] = {}
        self.links = [(name, re.compile(x), hint, policy) for name, x, hint, policy in (("urls", B.LINK, _LINK_HINT, options.links), ("emails", B.MAIL, _MAIL_HINT, options.mails)) if policy != "keep"]
        self.boilerplate = [re.compile(x, re.M) for x in options.boilerplate]
        self.footnotes = [re.compile(x) for x in options.footnotes]

    def __call__(self, text: str | None) -> tuple[str, list[int]]:
        t = Text(text or "")
        n = dict.fromkeys(self.counters, 0)
        n["input_chars"] = len(t.text)
        self.characters(t, n)
        self.markup(t, n)
        self.punctuation(t, n)
        self.tidy(t)
        self.look(t, n)
        return t.text, [n[c] for c in self.counters]

    def spans(self, t: Text) -> list[tuple[int, int, bool]]:
        if self.dotted and not t.has(_TOKEN):
            return []
        return [(a, b, False) for a, b in B.protected_spans(t.text, tuple(self.options.abbreviations))]

    def characters(self, t: Text, n: dict) -> None:
        """Line ends, composition, entities, damage, quotes, what can't be seen or heard, spaces."""
        p, o = self.p, self.options
        if "\r" in t.text or "\x85" in t.text or "\u2028" in t.text:
            t.sub(p["line_end"], "\n")
        if not t.text.isascii():
            t.text = t.text.replace("\u2029", "\n\n")
            t.text = unicodedata.normalize("NFC", t.text)
        if "&" in t.text:
            t.sub(p["entity"], _entity)
        wide = not t.text.isascii()
        if wide:
            able = 0xC2 in t.seen or "€" in t.text or "Ÿ" in t.text  # of these every sequence has one
            damage = [(*m.span(), True) for m in p["damage"].finditer(t.text)] if able and _DAMAGED.search(t.text) else []
            t.hold(damage)
            n["detected_mojibake_patterns"] = len(damage)
        quotes = [q for q in DOUBLE_QUOTES if q in t.text]
        if quotes:
            damage = list(t.spans)
            if self.quoted_short or self.quoting.search(t.text):
                t.hold(self.spans(t))
            if t.spans:
                n["double_quotes_normalized"] = t.sub(self.any_quote, "'")
            else:
                for q in quotes:
                    n["double_quotes_normalized"] += t.text.count(q)
                    t.text = t.text.replace(q, "'")
            t.spans = damage  # as long as before
        if wide and t.has(_INVISIBLE):
            n["removed_invisible_chars"] += t.sub(p["invisible"], "")
        if t.has(_CONTROL):
            n["removed_control_chars"] += t.sub(p["control"], "")
        if wide and o.emoji and t.has(_PICTURE) and ("\u20e3" in t.text or p["picture"].search(t.text)):
            n["removed_emoji"] += t.sub(p["emoji"], "")
        if "\u200c" in t.text or "\u200d" in t.text:
            self.joiners(t, n)
        n["normalized_spaces"] += self.one_space(t)

    def one_space(self, t: Text) -> int:
        if t.spaced is t.text:
            return 0
        n = 0
        if (t.has(_OTHER_SPACE) or "\u1680" in t.text) and any(c in t.text for c in _SPACES):
            n = t.sub(self.p["spaces"], " ")
        elif "  " in t.text:
            n = t.sub(_TWO_SPACES, " ")
        t.spaced = t.text if not t.spans else None
        return n

    def line_space(self, t: Text) -> None:
        if t.spans:
            if t.text[:1] == " " or t.text[-1:] == " " or "\n " in t.text or " \n" in t.text:
                t.sub(self.p["line_space"], "")
        elif "\n" in t.text:
            t.text = "\n".join([line.strip(" ") for line in t.text.split("\n")])
        else:
            t.text = t.text.strip(" ")

    def joiners(self, t: Text, n: dict) -> None:
        picture = self.p["picture"]

        def new(m: re.Match) -> str | None:
            beside = t.text[max(0, m.start() - 1) : m.start()] + t.text[m.end() : m.end() + 1]
            if not self.options.emoji and picture.search(beside):
                return None
            if not beside.isascii() and any(map(_other_letter, beside)):
                n["preserved_script_joiners"] += 1
                return None
            return ""

        n["removed_invisible_chars"] += t.sub(self.p["joiner"], new)

    def markup(self, t: Text, n: dict) -> None:
        """HTML, decoration, Markdown, links, lines of no content, bullets."""
        p, o = self.p, self.options
        if o.html and "<" in t.text:
            last = t.text.rfind("-->")
            n["removed_html_comments"] += t.apply(((*m.span(), "") for m in p["comment"].finditer(t.text, 0, last + 3)), over=True) if last >= 0 else 0
            n["removed_html_tags"] += t.sub(p["tag"], self.tag, over=True)
        if t.has(_DECORATION):
            n["removed_decorative_lines"] += t.apply(((*m.span(), "") for m in B.at_lines(p["decoration"], t.text)), over=True)
        if o.markdown:
            if "```" in t.text:
                t.sub(p["fence"], "", over=True)
                t.sub(p["fence_end"], "")
            if "#" in t.text or ">" in t.text:
                t.apply((m.start(), m.end(), "") for m in B.at_lines(p["heading_mark"], t.text))
            if "](" in t.text:
                t.apply(e for m in p["link"].finditer(t.text) for e in ((m.start(), m.start() + 1, ""), (m.end(1), m.start(2), " (")))
            gone = [e for mark in "*_`" if mark in t.text for e in unpaired(t.text, mark)]
            t.apply(sorted(gone))
        for name, pattern, hint, policy in self.links:
            label = self.labels[name] if policy == "replace" else " "
            able = any(x in t.text for x in (("@",) if name == "emails" else ("://", "w.", "W.")))
            found = B.in_words(pattern, hint, t.text) if able else ()
            n[("replaced_" if policy == "replace" else "removed_") + name] += t.apply(((m.start(), m.end(), label + m[0][len(m[0].rstrip(B.TRAILING)) :]) for m in found), over=True)
        if "=" in t.text:
            n["removed_metadata_lines"] += t.sub(p["metadata"], "", over=True)
        for pattern in self.boilerplate:
            n["removed_boilerplate_lines"] += t.sub(pattern, "", over=True)
        for pattern in self.footnotes:
            n["removed_footnotes"] += t.sub(pattern, "", over=True)
        if "•" in t.text or "●" in t.text or "▪" in t.text:
            t.apply(e for m in p["bullet"].finditer(t.text) for e in ((m.start(), m.start(1), ""), (m.end(), m.end(), "" if m[1][-1] in ".!?…" else ".")))
        if t.has(_WIDE) and self.any_wide.search(t.text):
            t.sub(self.any_wide, lambda m: self.wide[m[0]])
        n["normalized_spaces"] += self.one_space(t)

    def tag(self, m: re.Match) -> str:
        """What stands for an HTML tag."""
        name = m[1]
        if name not in self.block:
            self.block[name] = "\n" if self.blocks.fullmatch(name) else ""
        return self.block[name]

    def punctuation(self, t: Text, n: dict) -> None:
        """Runs and spacing of marks, dashes, headings; technical tokens are held from here on."""
        p = self.p
        t.hold(self.spans(t))
        if t.has(_MARK_OR_CLOSER):
            both = t.parted()
            if both:  # control characters are gone, so U+0000 is free
                self.marks(both[0], n)
                self.marks(both[1], n)
                t.join(*both)
            else:
                self.marks(t, n)
        if "-" in t.text or "–" in t.text or "—" in t.text:
            t.apply((m.start(), m.end(), "— ") for m in B.at_lines(p["dash"], t.text))
        self.line_space(t)
        if t.has(_DIGIT):
            n["repaired_heading_boundaries"] += t.apply([e for m in B.at_lines(p["spoken"], t.text) if (e := self.heading(m))])
        if self.options.sentence_per_line:
            t.apply((m.end(1), m.end(), "\n") for m in p["sentence"].finditer(t.text) if self.free(t, *m.span(1)))
        t.release()

    def marks(self, t: Text, n: dict) -> None:
        """Runs and spacing of marks. No match holds a letter or digit, or depends on more than the next character to either side."""
        p = self.p
        if "…" in t.text or _PERIODS.search(t.text):
            n["normalized_ellipsis"] += t.sub(p["ellipsis"], "…")
            if _PERIODS.search(t.text):
                n["normalized_double_period"] += t.sub(p["two_periods"], ".")

        def one(m: re.Match) -> str | None:
            new = "?!" if "?" in m[0] and "!" in m[0] else m[0][0]
            return None if new == m[0] else new

        if t.text.count("?") + t.text.count("!") > 1:
            n["collapsed_punctuation"] += t.sub(p["repeated"], one)
        before = len(t.text)
        if _SPACE_BEFORE.search(t.text):
            t.sub(p["space_before"], "")
        if t.spans:
            damage = {a for a, _, d in t.spans if d}
            n["fixed_missing_spaces"] += t.apply((m.end(), m.end(), " ") for m in p["no_space_after"].finditer(t.text) if self.free(t, *m.span()) and m.end() not in damage)
        elif t.has(_MARK):
            t.text, fixed = p["no_space_after"].subn(r"\g<0> ", t.text)
            n["fixed_missing_spaces"] += fixed
        n["spacing_char_delta"] += len(t.text) - before

    @staticmethod
    def free(t: Text, a: int, b: int) -> bool:
        """Whether no held character stands between two offsets."""
        k = bisect_right(t.spans, (a, 1 << 62, True))
        return not (k and t.spans[k - 1][1] > a) and not (k < len(t.spans) and t.spans[k][0] < b)

    def heading(self, m: re.Match) -> Edit | None:
        """An edit that parts a heading from the prose after it: at its first sentence end before an upper-case letter."""
        line = m[0]
        for cut in B.Places(line, tuple(self.options.abbreviations)).ends():
            rest = line[cut:].lstrip()
            if rest and rest[0].isupper():
                kept = line[:cut].rstrip(".…")
                return m.start() + len(kept), m.end() - len(rest), "\n\n"
        return None

    def tidy(self, t: Text) -> None:
        p = self.p
        self.one_space(t)
        self.line_space(t)
        if "\n\n" in t.text:
            t.sub(p["blank_lines"], "\n" * (self.options.blank_lines + 1))
        first = t.spans[0][0] if t.spans else len(t.text)
        lead = len(t.text[:first]) - len(t.text[:first].lstrip())
        last = t.spans[-1][1] if t.spans else 0
        tail = len(t.text[last:]) - len(t.text[last:].rstrip())
        t.apply([(0, lead, ""), (len(t.text) - tail, len(t.text), "")] if lead < len(t.text) else [(0, lead, "")])
        if not t.text.isascii():
            t.text = t.composed()

    def look(self, t: Text, n: dict) -> None:
        for name, firsts in _FOUND.items():
            if t.has(firsts):
                n[name] = len(self.p[name].findall(t.text))
        n["output_chars"] = len(t.text)
