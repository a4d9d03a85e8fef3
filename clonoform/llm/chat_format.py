"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks of the template. Every one holds "<|", which no escaped text can hold.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


#: Spans are placed by runs of so many texts, and read from pieces of 2**PIECE_BITS characters;
#: both only bound the work, which grows with the length of a conversation and not its square.
RUN, PIECE_BITS = 128, 10


def _let(value, body):
    """``body(value)`` with ``value`` computed once, wherever ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def escape(c):
    """Break all control strings reversibly: a backslash is doubled, and one follows each
    ``<`` and ``[``, so that neither ``<|``, ``</s>`` nor ``[INST]`` is left in a text."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(c):
    return F.regexp_replace(c, r"([<\[])\\|\\(\\)", "$1$2")


def _merged(turns):
    """Sorted turns as blocks of adjacent turns of one role: (role, bodies)."""
    role = lambda i: F.get(turns, i)["role"]
    heads = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))

    def block(heads, head, k):
        own = F.slice(turns, head + 1, F.coalesce(F.get(heads, k + 1), F.size(turns)) - head)
        return F.struct(role(head).alias("role"), F.transform(own, lambda t: t["body"]).alias("bodies"))

    return _let(heads, lambda heads: F.transform(heads, lambda head, k: block(heads, head, k)))


def _spans(texts):
    """(start, length) of the own ones of texts (own, gap, n, tail), which follow each other.
    Lengths are added up by run, then over the runs, then inside each run."""
    wide = lambda x: x["gap"] + x["n"] + x["tail"]
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(texts) - 1) / RUN).cast("int")), lambda k: F.slice(texts, k * RUN + 1, F.lit(RUN)))

    def placed(runs):
        sums = F.transform(runs, lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda n, x: n + wide(x)))
        starts = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda at, n: F.concat(at, F.array(F.try_element_at(at, F.lit(-1)) + n)))
        return _let(starts, lambda starts: F.flatten(F.transform(runs, lambda run, k: within(run, F.get(starts, k)))))

    def within(run, start):
        none = F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)")

        def place(acc, x):
            span = F.array(F.struct((acc["at"] + x["gap"]).alias("start"), x["n"].alias("length")))
            return F.struct((acc["at"] + wide(x)).alias("at"), F.when(x["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(run, F.struct(start.alias("at"), none.alias("spans")), place, lambda acc: acc["spans"])

    return _let(runs, placed)


def format_chats(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss (list of start and length, in characters).

    Rows of a conversation are sorted by turn (null first; ties by role, then text).
    Adjacent turns of one role are merged into one turn block whose texts stay apart by a
    text mark, so every row can be read back. The loss mask covers each text of
    ``loss_role``, escaped, without any mark. Null text and null role count as empty; null
    ``conv_id`` is a conversation of its own; an empty table gives no rows; other columns
    are ignored. A conversation is one output row, so its turns meet in one task.
    """
    plain = rows.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("body"),
        ).alias("t"),
    )
    turns = plain.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    blocks = turns.select("conv_id", _let(F.col("turns"), _merged).alias("blocks"))
    piece = lambda b: F.concat(F.lit(TURN), escape(b["role"]), F.lit(TEXT), F.array_join(b["bodies"], TEXT), F.lit(END))
    formatted = F.array_join(F.transform("blocks", piece), "")
    # places of the texts: offsets run over the flat list of bodies
    flat = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["bodies"],
                lambda x, i: F.struct(
                    (b["role"] == loss_role).alias("own"),
                    F.when(i == 0, F.lit(len(TURN)) + F.length(escape(b["role"])) + F.lit(len(TEXT))).otherwise(F.lit(len(TEXT))).cast("long").alias("gap"),
                    F.length(x).cast("long").alias("n"),
                    F.when(i == F.size(b["bodies"]) - 1, F.lit(len(END))).otherwise(F.lit(0)).cast("long").alias("tail"),
                ),
            ),
        )
    )
    return blocks.select("conv_id", formatted.alias("formatted"), _let(flat, _spans).alias("loss"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Turns and loss text, read back from formatted conversations: conv_id, turns (list of
    role and text), loss_text, formatted_chars."""
    blocks = F.split(F.col("formatted"), r"<\|end\|>")
    blocks = F.transform(F.slice(blocks, 1, F.size(blocks) - 1), lambda b: F.split(F.substring(b, len(TURN) + 1, 2147483647), r"<\|text\|>"))
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(F.slice(b, 2, F.size(b)), lambda x: F.struct(unescape(b[0]).alias("role"), unescape(x).alias("text"))),
        )
    )
    # a span is cut from the pieces that it lies in, not counted off from the first character
    pieces = F.regexp_extract_all("formatted", F.lit("(?s).{1,%d}" % (1 << PIECE_BITS)), F.lit(0))

    def text(pieces, s):
        first, last = (F.shiftright(x, PIECE_BITS).cast("int") for x in (s["start"], s["start"] + s["length"]))
        near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return unescape(F.substr(near, (s["start"].bitwiseAND(F.lit((1 << PIECE_BITS) - 1)) + 1).cast("int"), s["length"].cast("int")))

    loss = _let(pieces, lambda pieces: F.transform("loss", lambda s: text(pieces, s)))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
