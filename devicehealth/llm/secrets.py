"""Secret scans in column expressions: fixed patterns, and sliding-window entropy over long strings with an allow list."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The kinds of the fixed patterns, in the order they are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 characters and more; a shorter run holds no match
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]

#: Strings that entropy is measured on, by class: pattern, alphabet, least bits per character of a window.
CLASSES = {
    "hex": (r"[0-9a-fA-F]{20,}", "0123456789abcdefABCDEF", 3.05),
    "base64": (r"[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.85),
}
WINDOW = 20
#: What one of these finds is no secret: words, numbers, paths of words, alphabets, placeholders. An entry that begins with ``^``
#: frees a whole stretch; another one the part between separators that it lies in.
ALLOW = [r"^[A-Za-z_=-]+$", r"^[0-9]+$", r"^[A-Za-z_-]*/[A-Za-z_/-]*$", r"(?i:example|placeholder|changeme)", r"(?i:abcdefghij)", r"0123456789"]
#: A long string is measured in pieces that begin so many characters apart and overlap by a window.
PIECE = 256
#: Terms of the entropy are held as whole millionths, so that counts going in and out cancel exactly.
_SCALE = 1_000_000


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sums_before(sizes: Column) -> Column:
    """Sum of all earlier entries for each entry, by blocks of about the root of their number."""
    def by_block(step: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / step).cast("int")),
                             lambda b: F.aggregate(F.slice(sizes, b * step + 1, step), F.lit(0), lambda t, x: t + x))
        return _let(blocks, lambda known: F.transform(sizes, lambda _, i: F.aggregate(
            F.slice(known, F.lit(1), F.floor(i / step).cast("int")), F.lit(0), lambda t, x: t + x) + F.aggregate(
            F.slice(sizes, F.floor(i / step).cast("int") * step + 1, i % step), F.lit(0), lambda t, x: t + x)))

    return _let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(sizes))).cast("int")), by_block)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start, end, value>>``, in code points, end exclusive; value is the group."""
    rx = F.lit(pattern)

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))

        def at(parts: Column) -> Column:
            # Before match i stand the gaps 0 to i and the matches 0 to i-1.
            moved = F.transform(found, lambda m, i: parts[i] + F.when(i > 0, F.char_length(F.get(found, i - 1))).otherwise(0))
            return _let(moved, lambda steps: F.zip_with(_sums_before(steps), F.sequence(F.lit(1), F.size(found)), lambda before, i: before + steps[i - 1]))

        starts = _let(gaps, at)
        spans = F.zip_with(found, starts, lambda m, s: F.struct(s.alias("start"), (s + F.char_length(m)).alias("end"), m.alias("value")))
        if not group:
            return spans
        return F.zip_with(spans, F.regexp_extract_all(text, rx, F.lit(group)), lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))

    none = F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")
    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, rx, F.lit(0)), placed)).otherwise(none)


def _terms() -> list[int]:
    return [0, *(round(_SCALE * c * math.log2(c)) for c in range(1, WINDOW + 2))]


def _place(alphabet: Column, value: Column, i: Column) -> Column:
    """Number of the i-th character in the alphabet, 0 for one it has not."""
    return F.call_function("instr", alphabet, F.substr(value, i, F.lit(1)))


def hot_stretch(value: Column, alphabet: str, bits: float) -> Column:
    """``struct<first, last>``: from the first to the last window of the string whose entropy reaches ``bits``, as offsets; -1 if none does.

    Every window begins in one piece of ``PIECE`` characters and ends in it or in the next ones that the piece is given too, so
    the time grows with the length of the string alone.
    """
    pieces = F.regexp_extract_all(value, F.lit(f"(?=(.{{1,{PIECE + WINDOW - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    each = F.transform(pieces, lambda p, k: _let(_hot_piece(p, alphabet, bits), lambda h: F.struct(
        (h["first"] + k * PIECE).alias("first"), (h["last"] + k * PIECE).alias("last"), (h["last"] > 0).alias("hot"))))
    return _let(F.filter(each, lambda h: h["hot"]), lambda found: F.struct(
        F.coalesce(F.array_min(found["first"]), F.lit(-1)).alias("first"), F.coalesce(F.array_max(found["last"]), F.lit(-1)).alias("last")))


def _hot_piece(value: Column, alphabet: str, bits: float) -> Column:
    """The same of one piece. The window moves by one character: the counts of the one that comes in and the one that goes out
    change, and the sum of c log c by their terms alone."""
    most = math.floor(_SCALE * WINDOW * (math.log2(WINDOW) - bits))
    term = F.array(*(F.lit(t).cast("long") for t in _terms()))
    letters = F.lit(alphabet)
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"), F.lit(0).cast("long").alias("total"),
                     F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(s: Column, i: Column) -> Column:
        came = _place(letters, value, i)
        gone = F.when(i > WINDOW, _place(letters, value, i - WINDOW)).otherwise(-1)
        return _let(F.struct(came.alias("came"), gone.alias("gone")), lambda m: moved(s, i, m["came"], m["gone"]))

    def moved(s: Column, i: Column, came: Column, gone: Column) -> Column:
        c_in, c_out = F.get(s["counts"], came), F.coalesce(F.get(s["counts"], gone), F.lit(0))
        change = F.when(came == gone, F.lit(0).cast("long")).otherwise(
            F.get(term, c_in + 1) - F.get(term, c_in) + F.when(gone >= 0, F.get(term, c_out - 1) - F.get(term, c_out)).otherwise(F.lit(0).cast("long")))
        return _let(s["total"] + change, lambda total: F.struct(
            F.transform(s["counts"], lambda c, k: c + F.when(k == came, 1).otherwise(0) - F.when(k == gone, 1).otherwise(0)).alias("counts"), total.alias("total"),
            F.when((i >= WINDOW) & (total <= most) & (s["first"] < 0), i - WINDOW).otherwise(s["first"]).alias("first"),
            F.when((i >= WINDOW) & (total <= most), i).otherwise(s["last"]).alias("last")))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(value)), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _named(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each fixed kind; an assignment needs a value of six characters and more."""
    assign = F.filter(matches(text, ASSIGN, 2), lambda m: F.char_length(m["value"]) >= 6)
    return {"assign": _named(assign, "assign"), "access": _named(matches(text, ACCESS), "access"), "hex": _named(matches(text, HEX), "hex")}


def _stretches(m: Column, base: Column, marks: list[str]) -> Column:
    """What the base spans and the parts that one of ``marks`` finds leave of a long string: ``array<struct<start, end, value>>``
    of at least a window; parts lie between separators."""
    touching = F.transform(F.filter(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])),
                           lambda b: F.struct((b["start"] - m["start"]).alias("start"), (b["end"] - m["start"]).alias("end")))
    cuts = touching
    if marks:
        part = "(?<![A-Za-z0-9+])[A-Za-z0-9+]*?(?:" + "|".join(f"(?:{a})" for a in marks) + ")[A-Za-z0-9+]*"
        cuts = F.concat(touching, F.transform(matches(m["value"], part), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))))

    def left(cuts: Column) -> Column:
        end = F.struct(F.char_length(m["value"]).alias("start"), F.char_length(m["value"]).alias("end"))
        begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("out"))
        gaps = F.aggregate(F.concat(F.array_sort(cuts), F.array(end)), begin, lambda s, c: F.struct(
            F.greatest(s["at"], c["end"]).alias("at"),
            F.when(c["start"] - s["at"] >= WINDOW, F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), c["start"].alias("end"))))).otherwise(s["out"]).alias("out")), lambda s: s["out"])
        return F.transform(gaps, lambda g: F.struct((m["start"] + g["start"]).alias("start"), (m["start"] + g["end"]).alias("end"),
                                                    F.substr(m["value"], g["start"] + 1, g["end"] - g["start"]).alias("value")))

    return _let(cuts, lambda c: F.when(F.size(c) == 0, F.array(F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))).otherwise(left(c)))


def entropy_spans(text: Column, base: Column, allow: list[str] | None = None) -> Column:
    """Stretches of high entropy in long strings, in what base spans and the allow list leave of them."""
    allowed = ALLOW if allow is None else allow
    marks = [a for a in allowed if not a.startswith("^")]
    whole = [a for a in allowed if a.startswith("^")]
    found = F.flatten(F.transform(matches(text, CLASSES["base64"][0]), lambda m: _stretches(m, base, marks)))
    if whole:
        found = F.filter(found, lambda m: ~m["value"].rlike("|".join(f"(?:{a})" for a in whole)))
    as_hex = f"^{CLASSES['hex'][0]}$"

    def measured(m: Column) -> Column:
        hot = F.when(m["value"].rlike(as_hex), hot_stretch(m["value"], *CLASSES["hex"][1:])).otherwise(hot_stretch(m["value"], *CLASSES["base64"][1:]))
        return _let(hot, lambda h: F.struct((m["start"] + h["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"),
                                            (m["start"] + h["last"]).alias("end"), h["last"].alias("last")))

    hot = F.filter(F.transform(found, measured), lambda h: h["last"] > 0)
    return F.transform(hot, lambda h: F.struct(h["start"], h["kind"], h["end"]))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, text: str = "text", allow: list[str] | None = None) -> DataFrame:
    """Documents with ``__dh_base`` by kind and ``__dh_added``: spans as ``array<struct<start, kind, end>>``.

    Null text counts as empty: no spans. Repeated rows are each scanned; no key is needed. A text is scanned whole, in
    its row, whatever its length. Ties cannot arise: spans of a kind do not overlap. No rows: no rows. Other columns pass through.
    """
    whole = docs.withColumn("__dh_whole", F.coalesce(F.col(text), F.lit("")))
    base = base_spans(F.col("__dh_whole"))
    found = whole.withColumns({f"__dh_{k}": v for k, v in base.items()}).withColumn("__dh_base", F.concat(*(F.col(f"__dh_{k}") for k in base)))
    return found.withColumn("__dh_added", entropy_spans(F.col("__dh_whole"), F.col("__dh_base"), allow))


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", allow: list[str] | None = None) -> DataFrame:
    """The same rows and columns, each secret of ``text`` replaced by the mask; touching or overlapping spans by one. Null stays null."""
    spans = F.array_sort(F.concat("__dh_base", "__dh_added"))
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")

    def joined(held: Column, s: Column) -> Column:
        last = F.get(held, F.size(held) - 1)
        return F.when((F.size(held) > 0) & (s["start"] <= last["end"]), F.concat(
            F.slice(held, F.lit(1), F.size(held) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))).otherwise(
            F.concat(held, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    def cut(merged: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), merged["end"])
        starts = F.concat(merged["start"], F.array(F.char_length("__dh_whole")))
        return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substr(F.col("__dh_whole"), a + 1, b - a)), mask)

    clean = F.when(F.col(text).isNull() | (F.size(spans) == 0), F.col(text)).otherwise(_let(F.aggregate(spans, none, joined), cut))
    return scanned(docs, text, allow).withColumn("__dh_clean", clean).select(
        *(F.col("__dh_clean").alias(c) if c == text else F.col(c) for c in docs.columns))
