"""Chat formatting over typed content parts, in DataFrame functions only.

A visitor (``flatten_parts``) walks a turn's parts in order and flattens them to one text: a text part is escaped, an
image, audio or document part becomes a numbered placeholder token. Beside the text it records each attachment (number,
kind, reference, tokens it expands to). ``format_conversations`` then marks the turns and joins them per conversation:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Escaping is reversible: inside a text every ``<|`` becomes ``<||``, so a control string (``<|`` and no second bar) can
only come from the template; ``read_back`` undoes it. Neighbouring text parts are one text. In roles a line feed also
becomes ``<|n|>``.

Defined results: null texts, roles and references count as empty, null turns come first; a null conv_id is a conversation
of its own; repeated rows are turns of their own; ties of the turn number go by role, then text; unknown part kinds and
null parts are dropped from the text but counted in ``n_dropped``; texts of any length are formatted whole; empty tables
give empty results; columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_NUL = "\0"
#: Tokens that a placeholder stands for: image tiles, seconds of audio, pages; times the part's own ``units``.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 600}


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A turn's parts where it has a text only: array<struct<kind, text, ref, units>>."""
    none = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.alias("ref"), F.lit(None).cast("long").alias("units")))


def flatten_parts(parts: Column) -> Column:
    """struct<text, attachments array<struct<n, kind, ref, tokens>>, n_dropped> of array<struct<kind, text, ref, units>>."""
    known = F.filter(F.coalesce(parts, F.array()), lambda p: F.coalesce(p["kind"], F.lit("")).isin("text", *TOKENS_PER_UNIT))
    others = F.filter(known, lambda p: p["kind"] != "text")
    per = F.create_map(*[F.lit(x) for kv in TOKENS_PER_UNIT.items() for x in kv])
    listed = F.transform(
        others,
        lambda p, i: F.struct(
            i.alias("n"), p["kind"].alias("kind"), F.coalesce(p["ref"], F.lit("")).alias("ref"),
            (F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(0)) * per[p["kind"]]).cast("long").alias("tokens"),
        ),
    )
    # texts that meet are one text before they are escaped, so that no control string forms over their seam; marks keep
    # the attachments' places meanwhile
    marked = F.transform(known, lambda p: F.when(p["kind"] == "text", F.replace(F.coalesce(p["text"], F.lit("")), F.lit(_NUL), F.lit(_NUL + "t"))).otherwise(F.lit(_NUL + "a")))
    stretches = F.split(escape(F.array_join(marked, "")), _NUL + "a", -1)
    texts = F.transform(
        F.arrays_zip(stretches.alias("t"), others.alias("p")),
        lambda z, i: F.concat(
            F.replace(F.coalesce(z["t"], F.lit("")), F.lit(_NUL + "t"), F.lit(_NUL)),
            F.coalesce(F.concat(F.lit("<|"), z["p"]["kind"], F.lit(":"), i.cast("string"), F.lit("|>")), F.lit("")),
        ),
    )
    dropped = F.size(F.coalesce(parts, F.array())) - F.size(known)
    return F.struct(F.array_join(texts, "").alias("text"), listed.alias("attachments"), dropped.alias("n_dropped"))


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss array<struct<start, length>> (code points of formatted that
    are under the loss mask), attachments array<struct<turn_index, n, kind, ref, tokens>>, expanded_tokens, n_dropped."""
    role = F.coalesce(F.col(role_col), F.lit(""))
    parts = F.col(parts_col) if parts_col else text_part(F.col(text_col))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), flatten_parts(parts).alias("flat"))
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select(
        "conv_id",
        F.struct(
            "turn", "role", F.col("flat.text").alias("text"), head.alias("head"), (F.col("role") == loss_role).alias("learn"),
            (F.length(head) + F.length("flat.text") + len(END) + 1).cast("long").alias("span"), F.col("flat.attachments").alias("attachments"), F.col("flat.n_dropped").alias("n_dropped"),
        ).alias("t"),
    )
    made = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    made = made.withColumn("formatted", F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["text"], F.lit(END + "\n"))), ""))
    # starts of the turns: running sums, kept by one pass
    walk = F.aggregate(
        "ts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss")),
        lambda a, t: F.struct(
            (a["at"] + t["span"]).alias("at"),
            F.when(t["learn"], F.array_append(a["loss"], F.struct((a["at"] + F.length(t["head"])).cast("long").alias("start"), F.length(t["text"]).cast("long").alias("length")))).otherwise(a["loss"]).alias("loss"),
        ),
        lambda a: a["loss"],
    )
    attached = F.flatten(F.transform("ts", lambda t, i: F.transform(t["attachments"], lambda x: F.struct(i.alias("turn_index"), x["n"].alias("n"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))))
    made = made.withColumn("loss", walk).withColumn("attachments", attached)
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    dropped = F.aggregate("ts", F.lit(0).cast("long"), lambda a, t: a + t["n_dropped"])
    return made.select("conv_id", "formatted", "loss", "attachments", total.alias("expanded_tokens"), dropped.alias("n_dropped"))


def read_back(formatted: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What a trainer reads from format_conversations(): conv_id, turns array<struct<role, text>> (unescaped, with
    placeholders left in), loss_texts array<string> (each stretch under the mask, unescaped), formatted_chars and keep."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda p, i: i > 0)
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END) - 1)).alias("text"),
        ),
    )
    texts = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), texts.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"), *keep)
