"""Text clean-up, tokens and line layout as column expressions.

Java character classes are ASCII unless ``(?U)`` is given, so every pattern carries it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelake.functions import values as V

BREAK = "\u0001"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; lambdas would evaluate an outer expression per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def space_words(text: Column) -> Column:
    """Non-empty pieces between runs of white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def clean_punctuation(text: Column) -> Column:
    """Repeated words and marks, and spaces before marks, after the boundary word was handled."""
    text = F.regexp_replace(text, r"(?iU)\b(\w+)(?:\s+\1\b){2,}", "$1")
    text = F.regexp_replace(text, rf"([{V.PUNCTUATION}])\1+", "$1")
    text = F.regexp_replace(text, rf"(?U)\s+([{V.PUNCTUATION}])", "$1")
    return F.trim(text)


def drop_boundary_word(text: Column, previous: Column) -> Column:
    """Drop the first word of a collapsed text when it repeats ``previous`` and something remains."""
    head = F.regexp_extract(text, r"(?U)^(\w+)\b", 1)
    rest = F.regexp_replace(text, r"(?U)^\w+\b\s*", "")
    repeated = (previous != "") & (head != "") & (F.lower(head) == F.lower(previous)) & (rest != "")
    return F.when(F.coalesce(repeated, F.lit(False)), rest).otherwise(text)


def clean_fragment(text: Column, previous: Column | None = None) -> Column:
    text = collapse_space(text)
    if previous is not None:
        text = drop_boundary_word(text, previous)
    return clean_punctuation(text)


def last_word(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))


def wer_tokens(text: Column) -> Column:
    """Lower-case words; apostrophes stay for contractions."""
    return space_words(F.regexp_replace(F.lower(text), r"(?U)[^\w\s']", ""))


def bare_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""))


def _layout_pieces(text: Column) -> Column:
    """Words, single spaces, and the parts of hyphenated words and dashes, in order."""
    text = F.regexp_replace(
        text, r"(?U)(?<=[^\d\W]{2}-|[^\d\W]-[^\d\W]-)(?=[^\d\W]-?[^\d\W])", BREAK)
    text = F.regexp_replace(text, r"""(?U)(?<=[\w!"'&.,?])(-{2,})(?=\w)""", f"{BREAK}$1{BREAK}")
    text = F.regexp_replace(text, " ", f"{BREAK} {BREAK}")
    return F.filter(F.split(text, BREAK), lambda p: p != "")


def _split_long(piece: Column, room: Column, width: int) -> Column:
    """Cut an over-long piece: first to the room left on the line, then to whole lines, after a hyphen if any."""
    first = F.struct(F.array().cast("array<string>").alias("cut"), piece.alias("rest"), room.alias("room"))

    def cut(acc: Column, _: Column) -> Column:
        head = F.substring(acc["rest"], F.lit(1), acc["room"])
        dash = F.regexp_extract(head, r"^(-*[^-].*-)", 1)
        take = F.when(dash != "", F.length(dash)).otherwise(acc["room"])
        return F.when(
            F.length(acc["rest"]) > acc["room"],
            F.struct(
                F.array_append(acc["cut"], F.substring(acc["rest"], F.lit(1), take)).alias("cut"),
                F.substr(acc["rest"], take + 1).alias("rest"),
                F.lit(width).alias("room"),
            ),
        ).otherwise(acc)

    done = F.aggregate(F.sequence(F.lit(0), F.length(piece)), first, cut)
    return F.array_append(done["cut"], done["rest"])


def wrap_caption(text: Column, width: int = V.LINE_WIDTH, keep: int = V.MAX_LINES) -> Column:
    """Wrap a collapsed text to ``width`` and keep the last ``keep`` lines.

    Words break at hyphens; longer words are cut. The fold carries only the last lines, so the cost stays
    linear in the length of the text.
    """
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("cur"))

    def push(lines: Column, line: Column) -> Column:
        line = F.rtrim(line)
        more = F.array_append(lines, line)
        return F.when(line == "", lines).when(F.size(more) > keep, F.slice(more, -keep, keep)).otherwise(more)

    def place(acc: Column, piece: Column) -> Column:
        lines, cur = acc["lines"], acc["cur"]
        fits = F.length(cur) + F.length(piece) <= width
        fresh = F.when(piece == " ", "").otherwise(piece)
        room = F.lit(width) - F.length(cur)
        cuts = _split_long(piece, room, width)
        whole = F.concat(F.array(F.concat(cur, cuts[0])), F.slice(cuts, F.lit(2), F.size(cuts)))
        packed = F.aggregate(F.slice(whole, F.lit(1), F.size(whole) - 1), lines, push)
        return (
            F.when((piece == " ") & (cur == ""), acc)
            .when(fits, F.struct(lines.alias("lines"), F.concat(cur, piece).alias("cur")))
            .when(F.length(piece) <= width, F.struct(push(lines, cur).alias("lines"), fresh.alias("cur")))
            .otherwise(F.struct(packed.alias("lines"), F.element_at(whole, -1).alias("cur")))
        )

    return F.aggregate(_layout_pieces(text), start, place, lambda acc: push(acc["lines"], acc["cur"]))


def wrap_lines(text: Column, width: int = V.LINE_WIDTH, keep: int | None = None, chunk: int = 64) -> Column:
    """Wrap to ``width`` with over-long words kept whole; optionally keep the last ``keep`` lines.

    Words are folded ``chunk`` at a time, so that the lines so far are copied once per chunk and not once per word.
    """
    none = F.array().cast("array<string>")

    def push(lines: Column, line: Column) -> Column:
        more = F.array_append(lines, line)
        if keep:
            more = F.when(F.size(more) > keep, F.slice(more, -keep, keep)).otherwise(more)
        return F.when(line == "", lines).otherwise(more)

    def place(acc: Column, word: Column) -> Column:
        both = F.when(acc["cur"] == "", word).otherwise(F.concat(acc["cur"], F.lit(" "), word))
        return F.when(
            F.length(both) <= width, F.struct(acc["lines"].alias("lines"), both.alias("cur"))
        ).otherwise(F.struct(push(acc["lines"], acc["cur"]).alias("lines"), word.alias("cur")))

    def take(acc: Column, words: Column) -> Column:
        part = F.aggregate(words, F.struct(none.alias("lines"), acc["cur"].alias("cur")), place)
        return let(part, lambda p: F.struct(
            F.array_append(acc["parts"], p["lines"]).alias("parts"), p["cur"].alias("cur")))

    def fold(words: Column) -> Column:
        if keep:
            return F.aggregate(words, F.struct(none.alias("lines"), F.lit("").alias("cur")), place,
                               lambda acc: push(acc["lines"], acc["cur"]))
        chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(chunk)),
                             lambda i: F.slice(words, i, F.lit(chunk)))
        start = F.struct(F.array().cast("array<array<string>>").alias("parts"), F.lit("").alias("cur"))
        return F.aggregate(chunks, start, take, lambda acc: push(F.flatten(acc["parts"]), acc["cur"]))

    return let(space_words(text), fold)


def display_text(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def youtube_id(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/+", "")
    raw = F.try_parse_url(url, F.lit("QUERY"), F.lit("v"))
    query = F.coalesce(F.try_url_decode(raw), raw, F.lit(""))
    return (F.when(host == "youtu.be", path)
             .when(F.contains(host, F.lit("youtube")), query)
             .otherwise(F.lit("")))
