"""Settings of a job as JSON: loading with defaults, strict checks, and the options of the operators that follow from them.

Names and ranges are those of the settings files that users have.
"""

from __future__ import annotations

import codecs
import json
from dataclasses import MISSING, asdict, dataclass, field, fields

from pyspark.sql import SparkSession

from quire.functions.text import BRACKET_PAIRS
from quire.operators.clean import SYMBOL_WORDS, CleanOptions, Rule, SanitizeOptions
from quire.operators.detect import HeaderPattern, NormalizeOptions, build_patterns, custom_pattern

# Ranges of numbers, modes.
RANGES = {"zero_pad": (0, 12), "min_chunk_chars": (50, 20_000), "max_chunk_chars": (50, 20_000)}
MODES = ("keep", "strip", "remove")
#: Names in the settings' object of sanitizing, and those of its options.
SANITIZING = {
    "enabled": "enabled", "url_policy": "links", "email_policy": "mails", "remove_emoji": "emoji", "remove_html": "html", "remove_markdown_formatting": "markdown",
    "sentence_per_line": "sentence_per_line", "max_blank_lines": "blank_lines", "abbreviations": "abbreviations", "boilerplate_patterns": "boilerplate", "footnote_patterns": "footnotes",
}


@dataclass
class Settings:
    """What a job reads from its settings file; other entries of such a file are none of this library's."""

    encoding_chain: list = field(default_factory=lambda: ["utf-8-sig", "utf-8", "gb18030"])
    auto_insert_headers: bool = False
    auto_insert_prefix: str = "Chương {n}"
    continuous_numbering: bool = True
    chapter_prefix: str = "Chương {n}"
    zero_pad: int = 0
    header_separator: str = ": "
    keep_original_headers: bool = False
    detect_vietnamese: bool = True
    detect_english: bool = True
    detect_chinese: bool = True
    detect_plain_numbered: bool = False
    use_custom_chapter_regex: bool = False
    custom_chapter_regex: str = ""
    dedupe_chapters: bool = True
    prefer_vietnamese: bool = True
    enforce_period: bool = True
    normalize_spacing: bool = True
    remove_control_chars: bool = True
    remove_html: bool = True
    unescape_html_entities: bool = True
    quote_mode: str = "strip"
    bracket_mode: str = "strip"
    bracket_pairs: list = field(default_factory=lambda: list(BRACKET_PAIRS))
    custom_quote_chars: str = ""
    symbol_map_enabled: bool = True
    symbol_map: dict = field(default_factory=lambda: dict(SYMBOL_WORDS))
    custom_rules: list = field(default_factory=list)
    drop_empty_lines: bool = False
    max_chunk_chars: int = 700
    min_chunk_chars: int = 200
    chunk_by_chapters: bool = True
    tts_preprocessing: dict = field(default_factory=dict)

    def clean_options(self) -> CleanOptions:
        rules = tuple(Rule(str(r["pattern"]), str(r.get("replacement", "")), bool(r.get("regex", True))) for r in self.custom_rules if isinstance(r, dict) and r.get("pattern"))
        return CleanOptions(
            control=self.remove_control_chars, zero_width=self.remove_control_chars, html=self.remove_html, entities=self.unescape_html_entities, brackets=self.bracket_mode, bracket_pairs=tuple(self.bracket_pairs),
            quotes=self.quote_mode, quote_chars=self.custom_quote_chars, symbols=self.symbol_map if self.symbol_map_enabled else {}, rules=rules, spacing=self.normalize_spacing, drop_empty_lines=self.drop_empty_lines,
        )

    def normalize_options(self) -> NormalizeOptions:
        return NormalizeOptions(prefix=self.chapter_prefix, separator=self.header_separator, zero_pad=self.zero_pad, keep_headers=self.keep_original_headers, dedupe=self.dedupe_chapters, prefer_vietnamese=self.prefer_vietnamese, spacing=self.normalize_spacing, endings=self.enforce_period)

    def patterns(self) -> tuple[HeaderPattern, ...]:
        return build_patterns(vietnamese=self.detect_vietnamese, english=self.detect_english, chinese=self.detect_chinese, plain=self.detect_plain_numbered, custom=self.custom_chapter_regex if self.use_custom_chapter_regex else "")

    def sanitize_options(self) -> SanitizeOptions:
        """Raises a ValueError for entries that sanitizing doesn't have."""
        unknown = set(self.tts_preprocessing) - set(SANITIZING)
        if unknown:
            raise ValueError("unknown options of sanitizing: " + ", ".join(sorted(unknown)))
        return SanitizeOptions(**{SANITIZING[k]: tuple(v) if isinstance(v, list) else v for k, v in self.tts_preprocessing.items()})

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)


def _defaults() -> dict:
    return {f.name: f.default if f.default is not MISSING else f.default_factory() for f in fields(Settings)}


def coerced(data: object) -> Settings:
    """Settings of a loaded object: entries it doesn't have, that aren't known, or that hold another kind of container are as by default."""
    known, given = _defaults(), data if isinstance(data, dict) else {}
    kept = {k: v for k, v in given.items() if k in known and not (isinstance(known[k], (list, dict)) and not isinstance(v, type(known[k])))}
    out = Settings(**kept)
    if not out.encoding_chain:
        out.encoding_chain = known["encoding_chain"]
    return out


def load_settings(spark: SparkSession, path: str) -> Settings:
    """Settings of a JSON file, by any path that Spark reads; those by default where it can't be read or is no JSON."""
    from pyspark.errors import PySparkException

    try:
        rows = spark.read.text(path, wholetext=True).limit(1).collect()
        return coerced(json.loads(rows[0][0])) if rows else Settings()
    except (PySparkException, ValueError):
        return Settings()


def checked(data: dict) -> Settings:
    """Settings of edits that must be right; raises a ValueError that names the first that isn't."""
    known = _defaults()
    unknown = sorted(set(data) - set(known))
    if unknown:
        raise ValueError("unknown settings: " + ", ".join(unknown))
    out = Settings(**{**known, **data})
    tests = [
        *((type(getattr(out, k)) is type(v), f"{k} has another type than {type(v).__name__}") for k, v in known.items()),
        *((lambda k=k, a=a, b=b: a <= getattr(out, k) <= b, f"{k} must be between {a} and {b}") for k, (a, b) in RANGES.items()),
        (lambda: out.encoding_chain, "the chain of encodings is empty"),
        (lambda: all(map(_is_encoding, out.encoding_chain)), "unknown encoding"),
        (lambda: all(isinstance(p, str) and len(p) == 2 for p in out.bracket_pairs), "a pair of brackets has two characters"),
        (lambda: all(isinstance(r, dict) for r in out.custom_rules), "rules are objects"),
        (lambda: all(isinstance(x, str) for kv in out.symbol_map.items() for x in kv), "symbols map text to text"),
        (lambda: out.min_chunk_chars <= out.max_chunk_chars, "the least chunk exceeds the largest"),
        (lambda: {out.quote_mode, out.bracket_mode} <= set(MODES), "modes are " + ", ".join(MODES)),
    ]
    for test, reason in tests:
        if not (test() if callable(test) else test):
            raise ValueError(reason)
    if out.use_custom_chapter_regex:
        custom_pattern(out.custom_chapter_regex)
    out.sanitize_options()
    return out


def _is_encoding(name: object) -> bool:
    try:
        return isinstance(name, str) and codecs.lookup(name) is not None
    except LookupError:
        return False
