"""Prompts composed from parts: a shape says which parts there are, how likely each is and how it is joined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embermill.functions import rng

TRIES = 200


@dataclass(frozen=True)
class Part:
    """``options`` names the vocabulary's list (the part's own name if not given); ``unlike`` an earlier part, without
    which this one isn't there, and whose pick it doesn't repeat."""

    name: str
    chance: float = 1.0
    glue: str = ", "
    form: str = "{}"
    options: str | None = None
    unlike: str | None = None


# The shapes of the three generators (the first two share one) and the chance of each part.
PLAIN = (
    Part("subject", glue=""), Part("medium"), Part("aesthetic", 0.8, form="in a {} style"), Part("lighting", 0.85), Part("composition", 0.6), Part("mood", 0.6, form="{} mood"), Part("palette", 0.5), Part("quality", 0.7),
    Part("second", 0.5, options="quality", unlike="quality"),
)
WILD = (
    Part("entity", glue=""), Part("material", 0.8, glue=" "), Part("state", 0.85), Part("setting", 0.8), Part("fusion", 0.3, form="fused with {}", options="entity"), Part("style"), Part("extra"), Part("another", 0.5, options="extra"),
)


def compose(spark: SparkSession, n: int, seed: int, shape: tuple[Part, ...], words: dict[str, list[str]], tries: int = TRIES) -> DataFrame:
    """``prompt``: ``n`` different ones in the order in which they come up, from at most ``n * tries`` draws; fewer are
    an error. Draws are a function of (seed, part, number), so the prompts are the same whatever the partitioning."""
    draw = lambda stream: rng.uniform(rng.key(seed, stream, F.col("id")))
    there: dict[str, Column] = {}
    picks: dict[str, Column] = {}
    text = F.lit("")
    for p in shape:
        options = words[p.options or p.name]
        at, there[p.name] = F.floor(draw(p.name) * len(options)), draw(f"{p.name} there") < p.chance
        if p.unlike:
            there[p.name] = there[p.name] & there[p.unlike] & F.lit(len(options) > 1)
            at = F.pmod(picks[p.unlike] + 1 + F.floor(draw(p.name) * (len(options) - 1)), F.lit(len(options)))
        picks[p.name] = at
        before, after = p.form.split("{}")
        word = F.get(F.array(*[F.lit(o) for o in options]), at.cast("int"))
        text = F.concat(text, F.when(there[p.name], F.concat(F.lit(p.glue + before), word, F.lit(after))).otherwise(""))
    found = spark.range(n * tries).select("id", text.alias("prompt")).groupBy("prompt").agg(F.min("id").alias("g")).orderBy("g").limit(n).collect()  # the wanted number
    if len(found) < n:
        raise ValueError(f"only {len(found)} different prompts of {n}: the vocabulary is too small")
    return spark.createDataFrame([(r["prompt"],) for r in found], "prompt string")


def compose_sql(n: int, seed: int, shape: tuple[Part, ...], words: dict[str, list[str]], tries: int = TRIES) -> str:
    """The same for DuckDB."""
    draw = lambda stream: rng.uniform_sql(rng.key_sql(seed, stream, "g"))
    there: dict[str, str] = {}
    picks: dict[str, str] = {}
    text = "''"
    for p in shape:
        options = words[p.options or p.name]
        at, there[p.name] = f"floor({draw(p.name)} * {len(options)})", f"{draw(p.name + ' there')} < {p.chance}"
        if p.unlike:
            there[p.name] = f"{there[p.name]} AND {there[p.unlike]} AND {len(options) > 1}"
            at = f"(({picks[p.unlike]} + 1 + floor({draw(p.name)} * {len(options) - 1})) % {len(options)})"
        picks[p.name] = at
        before, after = p.form.split("{}")
        text += f" || CASE WHEN {there[p.name]} THEN '{p.glue + before}' || ({options})[({at} + 1)::int] || '{after}' ELSE '' END"
    return f"SELECT prompt FROM (SELECT prompt, min(g) AS g FROM (SELECT g, {text} AS prompt FROM range({n * tries}) AS r(g)) GROUP BY prompt) ORDER BY g LIMIT {n}"
