"""Text generation from bigram models, as joins over sample rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import seeded_bits
from ..functions.text import clean_output, output_budget, prompt_by_format, strip_prompt
from ..functions.tokens import Tokenizer, characters, count_and_last
from ..plans.joins import fits_broadcast, lookup_join
from ..plans.storage import materialize
from ..schemas import SAMPLE_SCHEMA

SEED = 81053
ROUNDS_PER_STAGE = 8

# Slots of alias tables sent to every executor.
SLOTS = 500_000
# Parts that tokens of one count are dealt to before they are put in order.
BUCKETS = 64
# A token whose preceding mass is this near to top-p is taken to be there, whatever the order of a sum.
ROUNDING = 1e-9
# A probability of 1 has two to this many parts.
_PARTS = 28
# Greedy paths: tokens that a frontier goes on in one job, and jobs before all contexts are taken.
FRONTIER_STEPS = 8
FRONTIER_JOBS = 8
# Each jump table goes this many times as far as the one before.
JUMP = 4
# Tokens of finished paths sent to every executor.
PATH_TOKENS = 10_000_000


def settings_grid(samples: DataFrame, grid: Sequence[dict]) -> DataFrame:
    """Every sample once per generation setting (temperature, top-p, …)."""
    names = list(grid[0])
    rows = [F.struct(*[F.lit(g[n]).alias(n) for n in names]) for g in grid]
    return samples.select("*", F.inline(F.array(*rows)))


def sampling_shape(
    counts: DataFrame, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None
) -> DataFrame:
    """``(model, ctx, token, p)``: what may follow and how likely.

    Frequencies are sharpened by the temperature, cut to the ``top_k`` most likely, then to those that
    start below ``top_p`` of the cumulated mass (those within ROUNDING of it start there), and scaled to 1.
    On ties the first tokens stay.

    All successors with one count are alike, so the cuts are found in the histogram of counts: a window
    holds the different counts of one context, at most the square root of twice its occurrences. Only
    where a cut goes through the tokens of one count are these put in order.
    """
    histogram = counts.groupBy("model", "ctx", "c").agg(F.count(F.lit(1)).alias("m"))
    context = Window.partitionBy("model", "ctx")
    order = context.orderBy(F.desc("c"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("c") * F.col("m")).over(context)
    shaped = histogram.withColumn("weight", F.pow(F.col("c") / total.cast("double"), F.lit(1.0 / temperature)))
    kept = F.col("m")
    if top_k is not None:
        ahead = F.coalesce(F.sum("m").over(before), F.lit(0))
        kept = F.greatest(F.lit(0), F.least(F.lit(top_k) - ahead, F.col("m")))
    shaped = shaped.withColumn("kept", kept.cast("bigint"))
    if top_p is not None:
        mass = F.col("kept") * F.col("weight")
        limit = F.sum(mass).over(context) * F.lit(top_p - ROUNDING)
        shaped = shaped.withColumn("room", limit - F.coalesce(F.sum(mass).over(before), F.lit(0.0)))
        within = F.least(F.ceil(F.col("room") / F.col("weight")), F.col("kept"))
        # Whatever the limits, the most likely token stays.
        first = (F.row_number().over(order) == 1).cast("bigint")
        shaped = shaped.withColumn("kept", F.greatest(first, within))
    shaped = shaped.withColumn("p", F.col("weight") / F.sum(F.col("kept") * F.col("weight")).over(context))
    shaped = shaped.where("kept > 0").select("model", "ctx", "c", "m", "kept", "p")
    rows = counts.join(shaped, ["model", "ctx", "c"])
    whole = rows.where("kept = m")
    cut = rows.where("kept < m").withColumn("_deal", F.pmod(F.xxhash64("token"), F.lit(BUCKETS)))
    for keys in (("model", "ctx", "c", "_deal"), ("model", "ctx", "c")):
        cut = cut.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("token"))).where("_place <= kept")
    return whole.select("model", "ctx", "token", "p").union(cut.select("model", "ctx", "token", "p"))


def alias_tables(shape: DataFrame) -> DataFrame:
    """``(model, ctx, slot, token, other, keep, size, token_size, other_size)``: draws in constant time.

    A context with ``size`` successors has as many slots, numbered from 0 and equally likely. A slot holds
    ``token`` up to ``keep`` of 2 ** 32 and ``other`` beyond; ``token_size`` and ``other_size`` are the sizes of the
    contexts that follow, null where the model knows none. So the next draw needs no look at the size.

    Probabilities are rounded to whole parts, with which everything is exact. Tokens below the mean give
    their slot's rest to the first token above the mean that has something left; when that falls below the mean
    itself, the next one fills its slot. Which one is found by cumulated deficits and excesses, in
    one order of both. A window holds the kept successors of one context.
    """
    context = Window.partitionBy("model", "ctx")
    parts = F.greatest(F.lit(1), F.round(F.col("p") * F.lit(float(1 << _PARTS)))).cast("bigint")
    rows = shape.select("model", "ctx", "token", parts.alias("parts"))
    rows = rows.withColumns({
        "size": F.count(F.lit(1)).over(context),
        "full": F.sum("parts").over(context),
        "slot": F.row_number().over(context.orderBy("token")) - 1,
    })
    gap = F.col("size") * F.col("parts") - F.col("full")
    rows = rows.withColumn("light", (gap <= 0).cast("int")).withColumn("gap", F.abs(gap))
    upto = F.sum("gap").over(Window.partitionBy("model", "ctx", "light").orderBy("token"))
    rows = rows.withColumn("upto", upto).withColumn(
        "at", F.when(F.col("light") == 1, F.col("upto") - F.col("gap")).otherwise(F.col("upto"))
    )
    order = context.orderBy("at", "light", "token")
    heavy = F.when(F.col("light") == 0, F.col("token"))
    # What follows is read from the end, as a frame that only grows is gone through once.
    back = context.orderBy(F.desc("at"), F.desc("light"), F.desc("token"))
    following = F.last(heavy, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    deficit = F.last(F.when(F.col("light") == 1, F.col("upto")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    left = F.when(F.col("light") == 1, F.col("full") - F.col("gap")).otherwise(
        F.col("full") + F.col("upto") - F.greatest(F.coalesce("deficit", F.lit(0)), F.col("upto"))
    )
    rows = rows.withColumn("other", following).withColumn("deficit", deficit).withColumn("left", left)
    alone = (F.col("left") >= F.col("full")) | F.col("other").isNull()
    slots = rows.select(
        "model", "ctx", "slot", "token",
        F.when(alone, F.col("token")).otherwise(F.col("other")).alias("other"),
        F.when(alone, F.lit(1 << 32)).otherwise(F.expr("shiftleft(left, 32) div full")).alias("keep"),
        "size",
    )
    sizes = shape.groupBy("model", "ctx").agg(F.count(F.lit(1)).alias("n"))
    for name in ("token", "other"):
        slots = slots.alias("a").join(sizes.alias("b"), F.expr(f"a.model = b.model AND a.{name} = b.ctx"), "left").select(
            "a.*", F.col("b.n").alias(f"{name}_size")
        )
    return slots


def likeliest(counts: DataFrame) -> DataFrame:
    """``(model, ctx, token)``: the most frequent successor, first in order on ties."""
    smallest = F.min_by("token", F.struct(-F.col("c"), F.col("token")))
    return counts.select("model", "ctx", "c", "token").groupBy("model", "ctx").agg(smallest.alias("token"))


def _step(rows: DataFrame, jump: DataFrame, at: str, to: str) -> DataFrame:
    """Adds the context ``to`` that ``jump`` (model, ctx, token) leads to from the context ``at``; null where none."""
    met = rows.alias("r").join(jump.alias("j"), F.expr(f"r.model = j.model AND r.{at} = j.ctx"), "left")
    return met.select("r.*", F.col("j.token").alias(to))


def reachable(greedy: DataFrame, starts: DataFrame) -> DataFrame:
    """The rows of ``greedy`` (model, ctx, token) for ``starts`` (model, ctx) and all contexts that they lead to.

    A frontier goes on FRONTIER_STEPS tokens a job and keeps what is new. Greedy paths soon run into
    contexts already seen; where they do not within FRONTIER_JOBS, all contexts are taken.
    """
    known = frontier = materialize(starts.select("model", "ctx").distinct(), "frontier")
    for _ in range(FRONTIER_JOBS):
        ahead = frontier.withColumnRenamed("ctx", "c0")
        for i in range(FRONTIER_STEPS):
            ahead = _step(ahead, greedy, f"c{i}", f"c{i + 1}")
        met = ahead.select("model", F.explode(F.array(*[f"c{i + 1}" for i in range(FRONTIER_STEPS)])).alias("ctx"))
        met = met.where("ctx IS NOT NULL").distinct()
        frontier = materialize(met.join(known, ["model", "ctx"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return greedy.join(known, ["model", "ctx"], "left_semi")
        known = known.union(frontier)
    return greedy


def jump_tables(steps: DataFrame, longest: int) -> list[DataFrame]:
    """Tables (model, ctx, token) of where 1, JUMP, JUMP ** 2, … steps lead, as far as ``longest`` asks for."""
    tables = [steps]
    while JUMP ** len(tables) <= longest:
        far = tables[-1].withColumnRenamed("token", "t1")
        for i in range(1, JUMP):
            far = _step(far, tables[-1], f"t{i}", f"t{i + 1}")
        far = far.where(F.col(f"t{JUMP}").isNotNull())
        tables.append(materialize(far.select("model", "ctx", F.col(f"t{JUMP}").alias("token")), "jumps"))
    return tables


def greedy_continuations(counts: DataFrame, starts: DataFrame | int) -> DataFrame:
    """``(model, ctx, tokens)``: the ``need`` likeliest tokens after each of ``starts`` (model, ctx, need).

    What follows depends on the last token only. Contexts that are reached from the starts get jump
    tables; a path is then laid out from its far jumps down to single steps, so it takes as many joins
    as its length has digits, and as many rows as tokens are asked for. A path ends early where the
    model knows no successor. Starts are different (model, ctx); a number asks for as many tokens after
    every context.
    """
    if isinstance(starts, int):
        starts = counts.select("model", "ctx").distinct().withColumn("need", F.lit(starts))
    starts = materialize(starts, "starts")
    longest = starts.agg(F.max("need")).first()[0] or 0
    greedy = materialize(likeliest(counts), "likeliest")
    tables = jump_tables(materialize(reachable(greedy, starts), "steps"), longest)
    places = starts.where("need > 0").select("model", F.col("ctx").alias("start"), "need", F.lit(0).alias("off"), F.col("ctx").alias("c0"))
    for level in reversed(range(len(tables))):
        for i in range(JUMP - 1):
            places = _step(places, tables[level], f"c{i}", f"c{i + 1}")
        on = [F.struct((F.col("off") + F.lit(i * JUMP**level)).alias("off"), F.col(f"c{i}").alias("c0")) for i in range(JUMP)]
        places = places.select("model", "start", "need", F.inline(F.array(*on))).where("off <= need AND c0 IS NOT NULL")
    # What stands at a place is the token before it.
    laid = places.where("off > 0").groupBy("model", F.col("start").alias("ctx"))
    ordered = F.sort_array(F.collect_list(F.struct("off", F.col("c0").alias("token"))))
    return laid.agg(ordered.alias("path")).select("model", "ctx", F.col("path.token").alias("tokens"))


def continue_greedily(open_rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``tokens``: up to ``budget`` likeliest tokens after the column ``last``.

    Each (model, last) gets one path, as long as the largest budget of its rows.
    """
    open_rows = materialize(open_rows, "open-rows")
    starts = open_rows.where("last IS NOT NULL").groupBy("model", F.col("last").alias("ctx")).agg(F.max("budget").alias("need"))
    paths = materialize(greedy_continuations(counts, starts), "continuations")
    # A path has no more tokens than the largest budget.
    longest = paths.agg(F.max(F.size("tokens"))).first()[0] or 1
    joined = lookup_join(
        open_rows.withColumn("ctx", F.col("last")), paths, ["model", "ctx"], "left", max_rows=PATH_TOKENS // longest
    )
    nothing = F.array().cast("array<string>")
    return joined.withColumn("tokens", F.slice(F.coalesce("tokens", nothing), F.lit(1), F.col("budget"))).drop("ctx")


def continue_sampled(
    open_rows: DataFrame, shape: DataFrame, key: Sequence[str], seed: int = SEED, max_rows: int | None = None
) -> DataFrame:
    """Adds ``tokens``: up to ``budget`` tokens drawn from the shaped models.

    The draw of step i depends on the seed, the row's ``key`` and i only, so results do not depend on how
    rows are spread. Alias tables of up to ``max_rows`` slots (SLOTS) go to every executor and each row is
    continued there to its end; larger ones are met in one equi-join per token until no row is open.
    """
    slots = materialize(alias_tables(materialize(shape.select("model", "ctx", "token", "p"), "shape")), "slots")
    if fits_broadcast(slots, SLOTS if max_rows is None else max_rows):
        return _draw_in_tasks(open_rows, slots.collect(), list(key), seed)
    return _draw_by_joins(open_rows, slots, list(key), seed)


def _draw_in_tasks(open_rows: DataFrame, slots: list, key: list[str], seed: int) -> DataFrame:
    choices: dict[tuple, list] = {}
    for row in slots:
        choices.setdefault((row["model"], row["ctx"]), [None] * row["size"])[row["slot"]] = (row["token"], row["other"], row["keep"])
    rows = open_rows.withColumn("_key", F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    own = rows.select("_key", "model", "last", "budget", *[c for c in open_rows.columns if c not in ("model", "last", "budget")])
    schema = T.StructType([*[f for f in own.schema if f.name != "_key"], T.StructField("tokens", T.ArrayType(T.StringType()))])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ends = [], []
            for name, model, last, budget in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                tokens: list[str] = []
                while len(tokens) < (budget or 0) and (model, last) in choices:
                    own = choices[model, last]
                    place = int(sha256(f"{name}|{len(tokens)}".encode()).hexdigest()[:8], 16) * len(own)
                    token, other, keep = own[place >> 32]
                    last = token if place & 0xFFFFFFFF < keep else other
                    tokens.append(last)
                out.append(tokens)
                ends.append(last)
            columns = list(batch.columns[1:])
            columns[1] = pa.array(ends, pa.string())
            yield pa.record_batch([*columns, pa.array(out, pa.list_(pa.string()))], names=[f.name for f in schema])

    return own.mapInArrow(draw, schema)


def _draw_by_joins(open_rows: DataFrame, slots: DataFrame, key: list[str], seed: int) -> DataFrame:
    """A row knows the size of its context from the draw before, so a step is one join on its slot."""
    sizes = slots.where("slot = 0").select("model", "ctx", "size")
    rows = open_rows.alias("r").join(sizes.alias("s"), F.expr("r.model = s.model AND r.last = s.ctx"), "left").select(
        "r.*", F.array().cast("array<string>").alias("tokens"), F.col("s.size").alias("_size")
    )
    rows = rows.withColumn("_size", F.when(F.col("budget") > 0, F.col("_size")))
    step = 0
    while True:
        place = seeded_bits(seed, *[F.col(k) for k in key], F.lit(step)) * F.col("_size")
        asked = rows.withColumn("_place", place).withColumn("_slot", F.shiftrightunsigned("_place", 32))
        met = asked.alias("r").join(
            slots.alias("s"), F.expr("r.model = s.model AND r.last = s.ctx AND r._slot = s.slot"), "left"
        )
        first = F.col("r._place").bitwiseAND(F.lit(0xFFFFFFFF)) < F.col("s.keep")
        drawn = F.when(first, F.col("s.token")).otherwise(F.col("s.other"))
        after = F.when(first, F.col("s.token_size")).otherwise(F.col("s.other_size"))
        met = met.select("r.*", drawn.alias("_next"), after.alias("_after"))
        grown = F.when(F.col("_next").isNull(), F.col("tokens")).otherwise(F.concat("tokens", F.array("_next")))
        rows = met.select(
            *[F.coalesce("_next", "last").alias(c) if c == "last" else c for c in open_rows.columns],
            grown.alias("tokens"),
            F.when(F.col("_next").isNotNull() & (F.size(grown) < F.col("budget")), F.col("_after")).alias("_size"),
        )
        step += 1
        if step % ROUNDS_PER_STAGE == 0:
            # Rows that are done are put aside and not carried through later joins.
            rows = materialize(rows, "round")
            still = rows.where("_size IS NOT NULL")
            ended = rows.where("_size IS NULL") if step == ROUNDS_PER_STAGE else ended.union(rows.where("_size IS NULL"))  # noqa: F821
            if still.isEmpty():
                return ended.drop("_size")
            rows = still


def best_of(candidates: DataFrame, group: Sequence[str], score: Column, output: str = "output") -> DataFrame:
    """The candidate with the highest score per group; the first slot wins ties.

    A group is one sample, model and slot, a handful of candidates.
    """
    rank = F.struct(score.alias("score"), (-F.col("candidate")).alias("order"))
    return candidates.groupBy(*group).agg(F.max_by(F.col(output), rank).alias(output))


def open_prompts(
    samples: DataFrame,
    models: DataFrame,
    tokenizer: Tokenizer = characters,
    dynamic: bool = True,
) -> DataFrame:
    """Samples fanned out to the models that support them, with prompt and budget.

    ``models`` has one row per supported (model, Language) with prompt_format
    and max_tokens. Adds ``full_prompt`` and, as next steps need them, ``last`` (the
    final prompt token) and ``budget``.
    """
    fanned = lookup_join(samples, models, ["Language"], spread_by=["sample_id"])
    prompted = fanned.withColumn(
        "full_prompt", prompt_by_format(F.col("prompt_format"), F.col("Language"), F.col("Prompt"))
    )
    prompt_tokens, last = count_and_last(tokenizer, F.col("full_prompt"))
    own = count_and_last(tokenizer, F.col("Code"))[0] if dynamic else None
    return prompted.withColumns({"last": last, "budget": output_budget(F.col("max_tokens"), prompt_tokens, own)})


def to_samples(generated: DataFrame, now: int) -> DataFrame:
    """Sample rows of generated text, sharing the source's prompt, corpus and language.

    Expects ``full_prompt``, the full ``output`` (prompt included), ``model`` and the
    setting columns TopK, TopP, Temperature of the run next to the source's columns.
    Where a column ``clean`` is false, as for base models, the continuation is kept as it is.
    """
    raw = strip_prompt(F.col("output"), F.col("full_prompt"))
    code = clean_output(raw)
    if "clean" in generated.columns:
        code = F.when(F.col("clean"), code).otherwise(raw)
    rows = generated.withColumn("Code", code).withColumn("Generator", F.col("model")).withColumn("Date", F.lit(now))
    return rows.select("sample_id", *[F.col(f.name).cast(f.dataType) for f in SAMPLE_SCHEMA])


def generate(samples: DataFrame, models: DataFrame, counts: DataFrame, now: int, dynamic: bool = True) -> DataFrame:
    """The greedy generation job: capability, prompt, continuation, clean-up, record."""
    rows = open_prompts(samples, models, dynamic=dynamic)
    done = continue_greedily(rows, counts)
    return to_samples(done.withColumn("output", F.concat("full_prompt", F.array_join("tokens", ""))), now)


def generate_sampled(
    samples: DataFrame,
    models: DataFrame,
    counts: DataFrame,
    now: int,
    grid: Sequence[dict],
    count: int = 1,
    best_of_n: int = 1,
    score: Column | None = None,
    dynamic: bool = True,
    seed: int = SEED,
) -> DataFrame:
    """The sampled generation job: every setting of the grid, ``count`` outputs, each the best of some.

    A setting has ``temperature``, ``top_k`` and ``top_p``; the rows carry it. Adds ``slot``, the number
    of the output among the ``count``. ``score`` rates the column ``output`` (the continuation) of a
    candidate; without it the first is taken.
    """
    rows = open_prompts(samples, models, dynamic=dynamic)
    slots = F.sequence(F.lit(0), F.lit(count * best_of_n - 1))
    rows = materialize(rows.withColumn("candidate", F.explode(slots)), "prompts")
    made = []
    for setting in grid:
        shape = sampling_shape(counts, setting.get("temperature") or 1.0, setting.get("top_k"), setting.get("top_p"))
        done = continue_sampled(rows.select("sample_id", "model", "last", "budget", "candidate"), shape,
                                ["sample_id", "model", "candidate"], seed)
        outputs = done.select(
            "sample_id", "model", F.floor(F.col("candidate") / best_of_n).cast("int").alias("slot"), "candidate",
            F.array_join("tokens", "").alias("output"),
        )
        best = best_of(outputs, ["sample_id", "model", "slot"], F.lit(0) if score is None else score)
        joined = rows.filter("candidate = 0").drop("candidate", "TopK", "TopP", "Temperature").join(best, ["sample_id", "model"])
        joined = joined.withColumn("output", F.concat("full_prompt", "output")).withColumns({
            "TopK": F.lit(setting.get("top_k")), "TopP": F.lit(setting.get("top_p")),
            "Temperature": F.lit(setting.get("temperature")),
        })
        made.append(to_samples(joined.withColumn("sample_id", F.struct("sample_id", "slot")), now)
                    .select("sample_id.sample_id", "sample_id.slot", *SAMPLE_SCHEMA.names))
    return reduce(DataFrame.unionByName, made)
