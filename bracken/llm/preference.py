"""Preference formatting of chosen and rejected conversations [native].

A pair has two conversations as arrays of turns (role, text). Their longest common prefix of turns is
rendered once as the prompt; what follows is rendered as two completions. The loss mask of a completion
is the code point spans that are trained: texts and ends of assistant turns, not their headers and not the
turns of others. The prompt is never trained.

Defined results: a null role is ``unknown`` and a null text empty; null or empty conversations have no
turns; equal conversations give a whole prompt and empty completions (status ``identical``); a pair of which
one side has no turn says so (``chosen_only``, ``rejected_only``); repeated turns stay and are ordered by turn,
role and text; turns without a number come first; an empty table gives no pair. A conversation is one array in
one row, as its rendering is one string; pairs are independent, so many equal conversations or first turns meet
in no task, and turns without a conversation's id are in no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays

HEAD, AFTER_ROLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"
_TURNS = "array<struct<role:string,text:string>>"


def _header(t: Column) -> Column:
    return F.concat(F.lit(HEAD), t["role"], F.lit(AFTER_ROLE))


def _rest(t: Column) -> Column:
    return F.concat(t["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(_header(t), _rest(t))))


def trained_spans(turns: Column) -> Column:
    """Spans [start, end) in code points of the rendering of ``turns`` that belong to the loss."""
    sizes = F.transform(turns, lambda t: F.struct(F.length(_header(t)).alias("head"), F.length(_rest(t)).alias("rest"), (t["role"] == TRAINED).alias("on")))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        after = at + s["head"] + s["rest"]
        return after, F.when(s["on"], F.struct((at + s["head"]).alias("start"), after.alias("end")))

    return arrays.folded(sizes, F.lit(0), step, "struct<start:int,end:int>")


def _clean(turns: Column) -> Column:
    some = F.coalesce(turns, F.array().cast(_TURNS))
    return F.transform(some, lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def formatted(pairs: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected as turns) to pair_id, status, n_prefix, prompt, and of each side the
    completion and its trained spans."""
    out = pairs.select("pair_id", _clean(F.col("chosen")).alias("_a"), _clean(F.col("rejected")).alias("_b")).withColumn("_m", F.size("_a")).withColumn("_n", F.size("_b"))
    shorter = F.least(F.size("_a"), F.size("_b"))
    same = F.zip_with(F.slice("_a", F.lit(1), shorter), F.slice("_b", F.lit(1), shorter), lambda a, b: a == b)
    differs = F.array_position(same, F.lit(False))
    out = out.withColumn("n_prefix", F.when(differs > 0, differs - 1).otherwise(shorter.cast("long")))
    tail = lambda c: F.slice(c, F.col("n_prefix").cast("int") + 1, F.greatest(F.size(c) - F.col("n_prefix").cast("int"), F.lit(0)))
    out = out.select("pair_id", "n_prefix", "_m", "_n", F.slice("_a", F.lit(1), F.col("n_prefix").cast("int")).alias("_p"), tail("_a").alias("_a"), tail("_b").alias("_b"))
    status = F.when((F.size("_a") == 0) & (F.size("_b") == 0), "identical").when(F.col("_m") == 0, "rejected_only").when(F.col("_n") == 0, "chosen_only").otherwise("pair")
    return out.select("pair_id", status.alias("status"), "n_prefix", render(F.col("_p")).alias("prompt"), render(F.col("_a")).alias("chosen"), render(F.col("_b")).alias("rejected"), trained_spans(F.col("_a")).alias("chosen_spans"), trained_spans(F.col("_b")).alias("rejected_spans"))


def every(turns: DataFrame) -> DataFrame:
    """A row of every conversation of a table of plain ones (conv_id, turn, role, text): conv_id, status, n_prefix,
    prompt, and of each side the completion and its trained spans. Every turn is in the row of its conversation.

    The whole conversation is chosen. Rejected is the same up to one of its assistant turns, and from there on what
    the other conversation of the pair (2k and 2k + 1) says from one of its own; of n assistant turns it is that of
    number k modulo n. Status ``unpaired``: the other one is missing or has no assistant turn; the own completion
    stands alone. Status ``no_reply``: no assistant turn; all turns are the prompt. Status ``no_id``: a turn without a
    conversation's id, which is a prompt by itself.
    """
    own = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    odd = F.pmod("conv_id", F.lit(2)) == 1
    side = lambda which: F.sort_array(F.collect_list(F.when(which, own)))
    both = turns.filter("conv_id IS NOT NULL").groupBy(F.floor(F.col("conv_id") / 2).cast("long").alias("_k")).agg(side(~odd).alias("_a"), side(odd).alias("_b"))
    rows = both.select("_k", F.explode(F.array(F.struct((F.col("_k") * 2).alias("id"), F.col("_a").alias("own"), F.col("_b").alias("other")), F.struct((F.col("_k") * 2 + 1).alias("id"), F.col("_b").alias("own"), F.col("_a").alias("other")))).alias("r")).filter(F.size("r.own") > 0)

    def at(t: Column) -> Column:
        """The place, from 0, of the assistant turn where a conversation's completion starts; null without any."""
        places = F.filter(F.transform(t, lambda x, i: F.when(x["role"] == TRAINED, i)), lambda i: i.isNotNull())
        return F.when(F.size(places) > 0, F.get(places, F.pmod(F.col("_k"), F.greatest(F.size(places), F.lit(1))).cast("int")))

    plain = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rows = rows.select(F.col("r.id").alias("conv_id"), plain(F.col("r.own")).alias("_t"), plain(F.col("r.other")).alias("_o"), at(F.col("r.own")).alias("_n"), at(F.col("r.other")).alias("_m"))
    state = F.when(F.col("_n").isNull(), "no_reply").when(F.col("_m").isNull(), "unpaired")
    before = F.slice("_t", F.lit(1), F.col("_n"))
    rejected = F.when(F.col("_n").isNull(), F.col("_t")).when(F.col("_m").isNull(), before).otherwise(F.concat(before, F.slice("_o", F.col("_m") + 1, F.size("_o"))))
    alone = turns.filter("conv_id IS NULL").select(F.lit(None).cast("long").alias("conv_id"), F.lit("no_id").alias("state"), F.array(F.struct("role", "text")).alias("chosen"))
    pairs = rows.select("conv_id", state.alias("state"), F.col("_t").alias("chosen"), rejected.alias("rejected")).unionByName(alone.withColumn("rejected", F.col("chosen")))
    out = formatted(pairs.select(F.struct("conv_id", "state").alias("pair_id"), "chosen", "rejected"))
    return out.select(F.col("pair_id.conv_id").alias("conv_id"), F.coalesce("pair_id.state", "status").alias("status"), *out.columns[2:])
