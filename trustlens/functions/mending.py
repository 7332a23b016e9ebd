"""Mending of almost-JSON: one pass over the tokens of a text with a running state, in column functions only.

The state is the brackets that are still open, what may follow, the quote an open text waits for, and the mended text so far. The pass ends with the
bracket that closes the first object. What it mends: trailing, doubled and missing commas; missing colons and values; single, curly and missing quotes;
names without quotes; True, False, None; quotes and line ends inside texts; wrong escapes; comments; brackets that are missing or closed in the wrong order.
The output is a JSON object for every text that starts with a brace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"""(?s)\\.?|["'“”{}\[\]:,]|\s+|[^\\"'“”{}\[\]:,\s][^\\"'“”{}\[\]:,\n]*"""
NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
COMMENT = r"(?s)(^|\s)(//|#|/\*).*"
PIECE = 4096  # a longer output is put aside, so that no step copies more


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _plain(text: Column) -> Column:
    """Characters that stand for themselves inside a JSON text."""
    text = F.replace(F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    return F.regexp_replace(text, r"[\x00-\x1F]", "")


BLANKS = [" ", "\n", "\r", "\t", "\f", "\x0b"]
QUOTES = ['"', "'", "“", "”"]


def _is_blank(token: Column) -> Column:
    """A token is blank if its first character is."""
    return F.left(token, F.lit(1)).isin(*BLANKS)


def _tokens(text: Column) -> Column:
    """Tokens, quotes with what their meaning depends on: the next token that is not blank, the blank between, the end of the token before."""

    def described(all_of: Column) -> Column:
        def around(i: Column) -> Column:
            def skip(at: Column) -> Column:
                return at + F.when(F.coalesce(_is_blank(F.get(all_of, at)), F.lit(False)), 1).otherwise(0)

            def seen(beyond: Column) -> Column:
                then, last = F.coalesce(F.get(all_of, skip(beyond + 1)), F.lit("")), F.coalesce(F.get(all_of, skip(beyond + 1) + 1), F.lit(""))
                return F.struct(
                    F.coalesce(F.left(F.get(all_of, beyond), F.lit(1)), F.lit("")).alias("next"), F.when(beyond > i + 1, F.get(all_of, i + 1)).otherwise("").alias("gap"),
                    F.coalesce(F.right(F.get(all_of, i - 1), F.lit(1)), F.lit(" ")).alias("before"),
                    (then.isin("", ",", '"', "'", "“", "{", "}", "]") | then.rlike("^(//|#|/\\*)") | (last == ":")).alias("name after next"),
                )

            return let(skip(i + 1), seen)

        def one(t: Column, i: Column) -> Column:
            follows = F.when(F.left(t, F.lit(2)) == "\\u", F.get(all_of, i + 1))
            return F.struct(t.alias("t"), follows.alias("follows"), F.when(t.isin(*QUOTES), around(i)).alias("at"))

        return F.transform(all_of, one)

    return let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), described)


def _inside(t: Column) -> Column:
    """What a token adds to an open text."""
    token, second = t["t"], F.substring(t["t"], 2, 1)
    unicode = (second == "u") & F.coalesce(t["follows"].rlike("^[0-9a-fA-F]{4}"), F.lit(False))
    escape = F.when(second.isin('"', "\\", "/", "b", "f", "n", "r", "t") | unicode, token).otherwise(_plain(second))
    return F.when(token == '"', '\\"').when(F.left(token, F.lit(1)) == "\\", escape).otherwise(_plain(token))


def _bare(token: Column) -> Column:
    return F.trim(F.regexp_replace(token, COMMENT, ""))


def _word(body: Column) -> Column:
    low = F.lower(body)
    return F.when(low.isin("true", "false"), low).when(low.isin("null", "none", "nan", "undefined"), "null").when(body.rlike(NUMBER), body).otherwise(_name(body))


def _name(body: Column) -> Column:
    return F.concat(F.lit('"'), _plain(body), F.lit('"'))


def _top(stack: Column) -> Column:
    """What may follow a finished value: names in an object ('k'), values in an array ('e'), nothing once all is closed ('z')."""
    last = F.right(stack, F.lit(1))
    return F.when(last == "o", "k").when(last == "a", "e").otherwise("z")


def _kind(s: Column, t: Column) -> Column:
    token, at = t["t"], t["at"]
    comma = (at["next"] == ",") & (at["name after next"] | ~s["mode"].isin("c", "v"))
    gap = (at["gap"] != "") & ((s["mode"] == "k") | at["next"].isin('"', "'", "“"))
    ends = (token == s["quote"]) & (at["next"].isin("", ":", "}", "]") | comma | F.contains(at["gap"], F.lit("\n")) | gap)
    opens = token.isin('"', "“") | ((token == "'") & at["before"].rlike(r"[\s{}\[\]:,]"))
    return (
        F.when(s["mode"] == "z", "skip").when(s["quote"] != "", F.when(ends, "close").otherwise("text"))
        .when(s["comment"], F.when(F.contains(token, F.lit("\n")), "resume").otherwise("skip"))
        .when(_is_blank(token), "skip").when(token.isin("{", "}", "[", "]", ":", ","), token).when(opens, "open")
        .when(token.isin(*QUOTES) | (F.left(token, F.lit(1)) == "\\"), "skip").when(_bare(token) == "", "comment").otherwise("bare")
    )


def _step(s: Column, t: Column) -> Column:
    mode, stack, out = s["mode"], s["stack"], s["out"]
    lead = F.when(mode == "c", ":").when(F.right(out, F.lit(1)).isin("{", "[", ":", ""), "").otherwise(",")
    missing = F.when(mode == "c", ':""').when(mode == "v", '""').otherwise("")
    finished = F.when(mode == "k", "c").when(mode.isin("c", "v"), "k").otherwise(mode)
    value_next = mode.isin("c", "v", "e", "r")

    def state(add=None, stack_=None, mode_=None, quote=None, comment=None) -> Column:
        return F.struct(
            s["parts"].alias("parts"), (out if add is None else F.concat(out, add)).alias("out"), (stack if stack_ is None else stack_).alias("stack"), (mode if mode_ is None else mode_).alias("mode"),
            (s["quote"] if quote is None else quote).alias("quote"), (s["comment"] if comment is None else comment).alias("comment"),
        )

    def closed(kind: str, other: str, end: str, other_end: str) -> Column:
        """Close the innermost bracket of a kind, and those of the other kind that stand open in it."""
        inner = F.length(F.regexp_extract(stack, f"{other}*$", 0))
        rest = F.substring(stack, F.lit(1), F.length(stack) - inner - 1)
        return F.when(F.contains(stack, F.lit(kind)), state(F.concat(missing, F.repeat(F.lit(other_end), inner), F.lit(end)), rest, _top(rest))).otherwise(state())

    def opened(kind: str, begin: str, then: str) -> Column:
        return F.when(value_next, state(F.concat(lead, F.lit(begin)), F.concat(stack, F.lit(kind)), F.lit(then))).otherwise(state())

    def moved(kind: Column) -> Column:
        return (
            F.when(kind == "skip", state()).when(kind == "text", state(_inside(t))).when(kind == "close", state(F.lit('"'), mode_=finished, quote=F.lit("")))
            .when(kind == "open", state(F.concat(lead, F.lit('"')), quote=F.when(t["t"] == "“", "”").otherwise(t["t"])))
            .when(kind == "bare", state(F.concat(lead, let(_bare(t["t"]), lambda b: F.when(mode == "k", _name(b)).otherwise(_word(b)))), mode_=finished, comment=t["t"].rlike(COMMENT)))
            .when(kind == ":", F.when(mode == "c", state(F.lit(":"), mode_=F.lit("v"))).otherwise(state()))
            .when(kind == ",", F.when(mode.isin("c", "v"), state(missing, mode_=F.lit("k"))).otherwise(state()))
            .when(kind == "{", opened("o", "{", "k")).when(kind == "[", opened("a", "[", "e")).when(kind == "}", closed("o", "a", "}", "]")).when(kind == "]", closed("a", "o", "]", "}"))
            .otherwise(state(comment=kind == "comment"))
        )

    def kept_short(after: Column) -> Column:
        size = F.length(after["out"])
        moved_on = F.struct(
            F.array_append(after["parts"], F.substring(after["out"], F.lit(1), size - 1)).alias("parts"), F.right(after["out"], F.lit(1)).alias("out"), after["stack"].alias("stack"),
            after["mode"].alias("mode"), after["quote"].alias("quote"), after["comment"].alias("comment"),
        )
        return F.when(size > PIECE, moved_on).otherwise(after)

    return let(let(_kind(s, t), moved), kept_short)


def mended(text: Column) -> Column:
    """The first object of a text that starts with a brace, as valid JSON."""
    start = F.struct(
        F.array().cast("array<string>").alias("parts"), F.lit("").alias("out"), F.lit("").alias("stack"), F.lit("r").alias("mode"), F.lit("").alias("quote"), F.lit(False).alias("comment")
    )

    def finish(s: Column) -> Column:
        mode = F.when(s["quote"] == "", s["mode"]).when(s["mode"] == "k", "c").otherwise("k")
        ends = F.concat(F.when(s["quote"] == "", "").otherwise('"'), F.when(mode == "c", ':""').when(mode == "v", '""').otherwise(""))
        return F.concat(F.array_join(s["parts"], ""), s["out"], ends, F.translate(F.reverse(s["stack"]), "oa", "}]"))

    return F.aggregate(_tokens(text), start, _step, finish)
