"""Text parsing as native column expressions."""

import json
from collections.abc import Callable
from functools import reduce
from html.entities import html5
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoinlake.fixed_values import NUMBER_PATTERN


def as_col(c: "Column | str") -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(c: Column, use: "Callable[[Column], Column]") -> Column:
    """`use(c)` with `c` computed once however often `use` names it, in a branch or a filter too."""
    return F.transform(F.array(c), use)[0]


def blank_to_null(c: "Column | str") -> Column:
    return F.nullif(as_col(c), F.lit(""))


def first_match(c: "Column | str", pattern: str, group: int = 1) -> Column:
    """Text of a regex group; NULL (not '') where the pattern does not occur."""
    return _once(F.regexp_extract(as_col(c), pattern, group), blank_to_null)


def first_number(c: "Column | str", pattern: str = NUMBER_PATTERN) -> Column:
    """First unsigned decimal in free text: '92.5 m²' gives 92.5."""
    return F.regexp_extract(as_col(c), pattern, 1).try_cast("double")  # no match is '', which is no number


def first_filled(*candidates: "Column | str") -> Column:
    """First candidate that is neither NULL nor '' nor zero, as text.

    JSON producers write absent fields as null, "" or 0 alike, so all three fall through.
    """
    def filled(t: Column) -> Column:
        # Only a text that is empty or begins with 0, - or the end of a line can be one of the three.
        maybe = F.instr(F.lit("0-\n\r\u0085\u2028\u2029"), F.substring(t, 1, 1)) > 0
        return F.when(maybe, F.when(~t.rlike(r"^(-?0+(\.0+)?)?$"), t)).otherwise(t)

    return F.coalesce(*[filled(as_col(c).cast("string")) for c in candidates])


def label_of(code: "Column | str", labels: dict[int, str], fallback: "Column | None" = None) -> Column:
    """Label of a code from a small literal map; the code's own text where it has none."""
    code = as_col(code)
    pairs = [F.lit(x) for k, v in labels.items() for x in (str(k), v)]
    return F.coalesce(
        F.create_map(*pairs)[code.cast("string")],
        code.cast("string") if fallback is None else fallback,
    )


def kv_lookup(items: "Column | str", wanted: str) -> Column:
    """Value of the last entry with the given id in an array<struct<id, value>>."""
    hits = F.filter(as_col(items), lambda e: e["id"] == wanted)
    return F.element_at(hits, F.when(F.size(hits) > 0, F.lit(-1)))["value"]


# A tag is "<", "</" or "<!" with a letter; its quoted values may hold angle brackets.
_TAG = r"""<[/!]?[a-zA-Z][^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
_GAP = "\\x00"  # stands for markup until all of it is found


def html_text(c: "Column | str", drop: tuple[str, ...] = ("script", "style")) -> Column:
    """Text nodes of an HTML fragment joined by one space, character references decoded.

    Comments go first; so do the elements in `drop`, with their content. Pass ``drop=()``
    to keep script and style text.
    """
    def step(text: Column, starts: "list[str]", pattern: str) -> Column:
        """Matches of `pattern` become a gap; only a text with one of its beginnings is searched for it."""
        return _once(text, lambda t: F.when(
            reduce(or_, [F.contains(t, F.lit(x)) for x in starts]), F.regexp_replace(t, pattern, "\0")).otherwise(t))

    text = step(as_col(c), ["<!--"], r"(?s)<!--.*?-->")
    for tag in drop:
        text = step(text, [f"<{tag[0].lower()}", f"<{tag[0].upper()}"], rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>")
    text = step(text, ["<"], _TAG)
    return unescape(F.regexp_replace(F.regexp_replace(text, f"^{_GAP}++|{_GAP}++$", ""), f"{_GAP}++", " "))


# Character references. The names come from the HTML5 table of the standard library.
_COMMON = {k: html5[k] for k in ("amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;")}
_UNTERMINATED = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
_REFERENCE = (
    r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;|"
    + "|".join(_UNTERMINATED)
    + ")"
)


def _literal_map(entries: dict[str, str]) -> Column:
    """A constant map in one expression; Spark folds it once when it plans."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


# Numbers of the C1 controls stand for the characters of windows-1252 where it has one.
_C1 = [bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)]


def _code_point(ref: Column) -> Column:
    digits = F.regexp_replace(F.regexp_extract(ref, r"([0-9a-fA-F]+);?$", 1), "^0+", "")
    digits = F.when(F.char_length(digits) < 8, digits).otherwise("")  # no character has so many
    is_hex = ref.rlike("^#[xX]")
    hexed = F.when(is_hex, digits).otherwise(F.conv(digits, 10, 16))
    code = F.conv(hexed, 16, 10).cast("bigint")
    allowed = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.when(code.between(0x80, 0x9F), F.lit(_C1)[(code - 0x80).cast("int")]).when(
        allowed, F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")
    ).otherwise(F.lit("�"))


def unescape(c: "Column | str") -> Column:
    """Decode named, decimal and hexadecimal HTML character references."""
    c = as_col(c)

    def decode(piece: Column) -> Column:
        ref = F.regexp_extract(piece, _REFERENCE, 1)
        rest = F.substr(piece, F.length(ref) + 2)
        char = F.when(ref.startswith("#"), _code_point(ref)).otherwise(
            F.coalesce(_literal_map(_COMMON)[ref], _literal_map(html5)[ref])
        )
        return F.when((ref == "") | char.isNull(), piece).otherwise(F.concat(char, rest))

    def whole(text: Column) -> Column:
        pieces = F.transform(F.split(text, "(?=&)"), decode)
        return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)

    return _once(c, whole)
