"""Queries of records and text: validation, lists, casts, names, sidecars, defaults."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from embermill.operators import records as R
from embermill.plans.common import GAL, gallery, sidecar, values, values_sql
from embermill.plans.registry import registry
from embermill.sources.tables import table

add = registry.add


# What a form may name.
_KNOWN = {"backend": ("sd15", "sd2", "sdxl", "flux2", "krea2"), "sampler": ("diagonal", "pca", "blend", "hybrid"), "neg_mode": ("mean", "empty", "zeros"), "scheduler": ("default", "ddim", "euler", "euler_a", "dpm")}
_FORM = {"backend": "sd15", "sampler": "diagonal"}  # of a form that names none; the others may be missing or empty
_NEG = "CASE job_id % 5 WHEN 0 THEN 'mean' WHEN 1 THEN '' WHEN 2 THEN 'none' END"  # the table has no such column


@add(
    "validate_enum",
    "SELECT job_id, received_at, CASE "
    + " ".join(f"WHEN {f'coalesce({c}, {chr(39)}{_FORM[c]}{chr(39)})' if c in _FORM else f'coalesce(nullif({c}, {chr(39)}{chr(39)}), {chr(39)}{k[0]}{chr(39)})'} NOT IN {k} THEN '{c}'" for c, k in _KNOWN.items())
    + f" END AS first_error FROM (SELECT *, {_NEG} AS neg_mode FROM run_requests)",
)
def validate_enum(spark: SparkSession, d: str) -> DataFrame:
    """The first field of a form that names nothing known, as it was written."""
    error = F.when(F.lit(False), F.lit(""))
    for c, known in _KNOWN.items():
        given = F.coalesce(c, F.lit(_FORM[c])) if c in _FORM else F.coalesce(F.nullif(c, F.lit("")), F.lit(known[0]))
        error = error.when(~given.isin(*known), c)
    return table(spark, d, "run_requests").withColumn("neg_mode", F.expr(_NEG)).select("job_id", "received_at", error.alias("first_error"))


# Film forms made of events (no table holds any), so that every rule is broken and kept.
_FILM_FORMS = """SELECT event_id, event_id % 67 AS keys, event_id * 7 % 66 - 2 AS fps, CASE WHEN event_id % 11 = 0 THEN 40 ELSE event_id * 13 % 500 END AS frames_per, event_id % 25 / 20.0D AS noise_window,
event_id % 40 / 12.0D AS scale, event_id % 23 / 20.0D AS strength, CASE WHEN event_id % 4 > 0 THEN 40 + event_id % 253 * 8 END AS height, CASE WHEN event_id % 3 > 0 THEN 512 + event_id % 2 * 4 END AS width, event_id % 2 = 0 AS loop FROM events"""
_RULES = [
    ("keys", "keys BETWEEN 2 AND 64"), ("fps", "fps BETWEEN 1 AND 60"), ("frames_per", "frames_per BETWEEN 1 AND 480"), ("noise_window", "noise_window BETWEEN 0.05 AND 1.0"), ("scale", "scale > 0 AND scale <= 3.0"),
    ("strength", "strength > 0 AND strength <= 1.0"), ("height", "coalesce(height BETWEEN 64 AND 2048 AND height % 8 = 0, true)"), ("width", "coalesce(width BETWEEN 64 AND 2048 AND width % 8 = 0, true)"),
    ("frames", "(CASE WHEN loop THEN keys ELSE keys - 1 END) * frames_per + 1 <= 3000"),
]


@add("validate_ranges", "SELECT event_id, CASE " + " ".join(f"WHEN NOT ({rule}) THEN '{name}'" for name, rule in _RULES) + f" END AS first_error FROM ({_FILM_FORMS.replace('0D', '0::double')})")
def validate_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that a film's form breaks; a missing size breaks none."""
    error = F.when(F.lit(False), F.lit(""))
    for name, rule in _RULES:
        error = error.when(~F.expr(rule), name)
    made = _FILM_FORMS.removeprefix("SELECT ").removesuffix(" FROM events")
    return table(spark, d, "events").selectExpr(*re.split(r",\s+", made)).select("event_id", error.alias("first_error"))


_LISTS = [(1, "0.8, 1.0,1.6"), (2, " 7 ,, 8 "), (3, "1,x,3"), (4, ""), (5, None), (6, "1e3,-2.5"), (7, ",")]


@add(
    "clean_csv",
    f"""WITH p AS (SELECT id, list_filter(list_transform(string_split(txt, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM {values_sql(_LISTS, 'id, txt')})
    SELECT id, CASE WHEN parts IS NOT NULL AND len(list_filter(parts, lambda x: try_cast(x AS double) IS NULL)) = 0 THEN coalesce(array_to_string(parts, ','), '') END AS cleaned FROM p""",
)
def clean_csv(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, _LISTS, "id int, txt string").select("id", R.clean_numbers(F.col("txt")).alias("cleaned"))


# What a form's missing fields mean for each backend.
_DEFAULTS = [("sd15", 30, 7.5, "empty", 512, 512), ("sd2", 30, 9.0, "empty", 768, 768), ("sdxl", 1, 0.0, "mean", 1024, 1024), ("flux2", 28, 4.0, "empty", 1024, 1024), ("krea2", 28, 4.5, "empty", 1024, 1024)]


@add(
    "resolve_defaults",
    f"""SELECT r.job_id, r.received_at, k.backend, coalesce(r.steps, k.steps) AS steps, coalesce(r.guidance, k.guidance) AS guidance, k.neg_mode, k.height, coalesce(nullif(r.width, 0), k.width) AS width
    FROM run_requests r JOIN {values_sql(_DEFAULTS, 'backend, steps, guidance, neg_mode, height, width').replace(' AS t(', ' AS k(')} ON k.backend = coalesce(lower(trim(r.backend)), 'sd15')""",
)
def resolve_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Missing fields filled with the backend's defaults; a size of 0 counts as missing. (The table has no negative
    mode and no height, so these are always the defaults.) The defaults are a fixed list and are broadcast."""
    k = values(spark, _DEFAULTS, "backend string, d_steps int, d_guidance double, neg_mode string, height int, d_width int")
    r = table(spark, d, "run_requests").withColumn("backend", F.coalesce(F.lower(F.trim("backend")), F.lit(R.DEFAULT_BACKEND)))
    return r.join(F.broadcast(k), "backend").select(
        "job_id", "received_at", "backend", F.coalesce("steps", "d_steps").alias("steps"), F.coalesce("guidance", "d_guidance").alias("guidance"), "neg_mode", "height", F.coalesce(F.nullif("width", F.lit(0)), F.col("d_width")).alias("width")
    )


# Which fields of the form show for which values of others.
_VISIBLE = [("coherence", "sampler", "blend"), ("components", "sampler", "pca,blend"), ("target_distance", "action", "generate"), ("scheduler", "action", "generate,temp_sweep,sampler_sweep")]


@add(
    "visible_fields",
    f"""SELECT r.job_id, f.field FROM (SELECT DISTINCT job_id, sampler, action FROM run_requests) r, {values_sql(_VISIBLE, 'field, on_key, allowed').replace(' AS t(', ' AS f(')}
    WHERE list_contains(string_split(f.allowed, ','), CASE f.on_key WHEN 'sampler' THEN r.sampler ELSE r.action END)""",
)
def visible_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields whose condition holds: every key of ``when`` must have one of its values."""
    rules = F.array(*[F.struct(F.lit(f).alias("field"), F.create_map(F.lit(k), F.split(F.lit(a), ",")).alias("when")) for f, k, a in _VISIBLE])
    r = table(spark, d, "run_requests").select("job_id", "sampler", "action").distinct()
    now = r.select("job_id", F.create_map(F.lit("sampler"), F.col("sampler"), F.lit("action"), F.col("action")).alias("now"), F.explode(rules).alias("rule"))
    shown = F.forall(F.map_entries("rule.when"), lambda e: F.coalesce(F.array_contains(e["value"], F.col("now")[e["key"]]), F.lit(False)))
    return now.filter(shown).select("job_id", F.col("rule.field").alias("field"))


@add("vocab_mask", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) WHERE regexp_full_match(word, '[a-z0-9]+') GROUP BY 1")
def vocab_mask(spark: SparkSession, d: str) -> DataFrame:
    """Words of the corpus that a clean vocabulary keeps."""
    w = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("word"))
    return w.filter(F.col("word").rlike("^[a-z0-9]+$")).groupBy("word").agg(F.count("*").alias("n"))


# Fixed value: the order in which an image's parameters are shown.
_ORDER = """kind mode parent parent_b distance anchor_distance radius mutate direction step walk_frame target_distance elites base_blend dist backend model sampler temperature coherence components comp_lo equalize truncation
steps guidance scheduler neg_mode height width init_image init_mode init_strength ip_scale batch_seed image_seed index refined_from cond_from engine factor denoise denoise_steps interp scale strength cond_reused src_size out_size
seed""".split()


@add(
    "param_dump",
    f"WITH {GAL}, m AS (SELECT rel, meta_raw FROM gal WHERE json_valid(meta_raw)), c AS (SELECT rel, unnest(range({len(_ORDER)}))::int AS place, unnest({_ORDER}) AS param, unnest([" + ", ".join(f"meta_raw->>'$.{c}'" for c in _ORDER) + "]) AS value FROM m) SELECT * FROM c WHERE value IS NOT NULL",
)
def param_dump(spark: SparkSession, d: str) -> DataFrame:
    """An image's parameters in a fixed order, without those that are missing or null."""
    meta = F.from_json("meta_raw", "map<string,string>")
    ok = sidecar("kind string")  # a sidecar that is cut off has none
    g = gallery(spark, d).withColumn("m", F.when(F.get_json_object("meta_raw", "$").isNotNull() & ok["kind"].isNotNull(), meta)).filter("m is not null")
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("param"), F.col("m")[c].alias("value")) for i, c in enumerate(_ORDER)])
    return g.select("rel", F.inline(cells)).filter("value is not null")


_SLUG = "substr(regexp_replace(regexp_replace({c}, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40)"


@add("slugify", f"SELECT id, {_SLUG.format(c='label')} AS slug FROM jobs")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("id", R.slug(F.col("label")).alias("slug"))


@add("unique_names", f"WITH s AS (SELECT id, coalesce({_SLUG.format(c='label')}, 'film') AS slug FROM jobs), k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY id) AS n FROM s) SELECT id, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS name FROM k")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    """Slugs made unique: the second user of a name gets -2, and so on."""
    s = table(spark, d, "jobs").select("id", F.coalesce(R.slug(F.col("label")), F.lit("film")).alias("slug"))
    return R.unique_names(s, "slug", "id", "-", 2).select("id", F.col("unique").alias("name"))


@add("sidecar_json", "SELECT job_id, '{\"sampler\":\"' || sampler || '\",\"steps\":' || steps || ',\"seed\":' || seed || '}' AS meta FROM run_requests WHERE sampler IS NOT NULL AND steps IS NOT NULL AND seed IS NOT NULL")
def sidecar_json(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "run_requests").filter("sampler is not null and steps is not null and seed is not null")
    return r.select("job_id", F.to_json(F.struct("sampler", "steps", "seed")).alias("meta"))


@add("sidecar_merge", f"WITH {GAL}, m AS (SELECT rel, CASE WHEN json_valid(meta_raw) THEN meta_raw->>'$.sampler' END AS sampler, CASE WHEN json_valid(meta_raw) THEN meta_raw->>'$.kind' END AS kind FROM gal) SELECT rel, CASE WHEN length(rel) % 2 = 0 THEN 'edited' ELSE sampler END AS sampler, kind FROM m")
def sidecar_merge(spark: SparkSession, d: str) -> DataFrame:
    """Sidecars updated with new fields, which win; here a new sampler for paths of even length."""
    meta = F.from_json("meta_raw", "sampler string, kind string, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    g = gallery(spark, d).select("rel", meta.alias("m"))
    known = lambda c: F.when(F.col("m._broken").isNull(), F.col(f"m.{c}"))
    old = F.map_filter(F.create_map(F.lit("sampler"), known("sampler"), F.lit("kind"), known("kind")), lambda k, v: v.isNotNull())
    new = F.when(F.length("rel") % 2 == 0, F.create_map(F.lit("sampler"), F.lit("edited")))
    return g.withColumn("merged", R.merged(old, new)).select("rel", F.col("merged")["sampler"].alias("sampler"), F.col("merged")["kind"].alias("kind"))


_PROBES = "(SELECT rel FROM gal WHERE nov IS NOT NULL ORDER BY nov DESC, rel LIMIT 40) UNION ALL SELECT unnest(['gone.png', 'notes.txt'])"


@add("keyframe_probe", f"WITH {GAL}, q(rel) AS ({_PROBES}) SELECT q.rel, g.size, CASE WHEN q.rel NOT LIKE '%.png' THEN 'no image' WHEN g.rel IS NULL THEN 'not found' END AS error FROM q LEFT JOIN gal g USING (rel)")
def keyframe_probe(spark: SparkSession, d: str) -> DataFrame:
    """A row for each asked keyframe, with an error text instead of a failure. At most 64 are asked at once, so the
    asked ones are broadcast."""
    g = gallery(spark, d)
    q = g.filter("nov is not null").orderBy(F.desc("nov"), "rel").limit(40).select("rel").union(values(spark, [("gone.png",), ("notes.txt",)], "rel string"))
    found = g.select("rel", "size").join(F.broadcast(q.limit(64)), "rel", "left_semi")
    j = q.join(found, "rel", "left")
    return j.select("rel", "size", F.when(~F.col("rel").endswith(".png"), "no image").when(F.col("size").isNull(), "not found").alias("error"))


@add("list_move", "SELECT CASE WHEN ord = 2 THEN 6 WHEN ord > 2 AND ord <= 6 THEN ord - 1 ELSE ord END::int AS ord, item FROM (SELECT row_number() OVER (ORDER BY corpus) - 1 AS ord, corpus AS item FROM corpora)")
def list_move(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpora").select((F.row_number().over(W.orderBy("corpus")) - 1).alias("ord"), F.col("corpus").alias("item"))
    return R.move(c, 2, 6)


# Expressions with their values by the field's rules: a sign binds tighter than a power, a number ends with a digit,
# only blanks may stand between.
_SUMS = [
    ("1 + 2 * 3", 7.0), ("(1 + 2) * 3", 9.0), ("2 ^ 3 ^ 2", 512.0), ("-2 ^ 2", 4.0), ("-2^2", 4.0), ("-(2 ^ 2)", -4.0), ("2 ^ -1", 0.5), ("7 % 4 - 1", 2.0), ("-7 % 4", -3.0), ("1 / 0", None), ("2 +", None), ("1024 * 0.5", 512.0),
    ("((3))", 3.0), ("3 3", None), ("", None), (None, None), ("5 % 0", None), ("--3", 3.0), ("1.", None), (".5", 0.5), ("1.5.2", None), ("1\t+ 2", None), (" 8 ", 8.0), ("1e3", None), ("(-8) ^ 0.5", None), ("10 ^ 400", None), ("(1", None), ("0 ^ 0", 1.0),
]


@add("calc_eval", f"SELECT txt, value FROM {values_sql(_SUMS, 'txt, value')}")
def calc_eval(spark: SparkSession, d: str) -> DataFrame:
    return R.with_value(values(spark, [(t,) for t, _ in _SUMS], "txt string"), "txt")


_FIELDS = [("1024+256", True, "1280"), ("1024", True, None), ("1000 / 3", True, "333"), ("1000/3", False, "333.333333"), ("2.50", False, "2.5"), ("-2.5", True, "-2"), ("x", False, None), ("1/8", False, "0.125"), ("0.0000001 * 1", False, "0"), (" 7 ", True, None)]


@add("calc_field", f"SELECT txt, whole, shown FROM {values_sql(_FIELDS, 'txt, whole, shown')}")
def calc_field(spark: SparkSession, d: str) -> DataFrame:
    """What a number field shows after its expression; null where it stays as typed."""
    return R.with_field(values(spark, [f[:2] for f in _FIELDS], "txt string, whole boolean"), "txt", "whole")


@add("cast_values", "SELECT event_id, try_cast(nullif(trim(CASE WHEN event_id % 5 = 0 THEN ' ' WHEN event_id % 7 = 0 THEN 'n/a' ELSE ' ' || user_id || ' ' END), '') AS double) AS number, event_id % 3 = 1 AS flag FROM events")
def cast_values(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, " ").when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")))
    return table(spark, d, "events").select("event_id", R.as_number(text).alias("number"), R.as_flag((F.col("event_id") % 3).cast("string")).alias("flag"))


@add(
    "byte_sizes",
    f"""WITH {GAL}, b AS (SELECT rel, size FROM gal UNION ALL SELECT 'edge-' || n, n FROM (SELECT unnest([0, 499, 500, 1000000, 1000001, 1149999, 1150000, 1250000, 1949999, 1950000, 1950001, 123456789012])::bigint AS n)),
    t AS (SELECT rel, size, size / 1e6::double AS m, floor(size / 1e6::double * 10)::bigint AS f FROM b), sized AS (SELECT *, CASE WHEN m - f / 10::double < (f + 1) / 10::double - m THEN f ELSE f + 1 END AS k FROM t)
    SELECT rel, CASE WHEN size > 1000000 THEN (k // 10) || '.' || (k % 10) || 'M' ELSE floor(size / 1e3::double + 0.5)::bigint || 'K' END AS shown FROM sized""",
)
def byte_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of all images as the gallery shows them, and of some on the edge."""
    edges = spark.createDataFrame([(f"edge-{n}", n) for n in (0, 499, 500, 1000000, 1000001, 1149999, 1150000, 1250000, 1949999, 1950000, 1950001, 123456789012)], "rel string, size bigint")
    return gallery(spark, d).select("rel", "size").unionByName(edges).select("rel", R.byte_size(F.col("size")).alias("shown"))


@add("repro_cli", "SELECT job_id, received_at, concat_ws(' ', 'generate', '--backend', coalesce(lower(trim(backend)), 'sd15'), CASE WHEN sampler IS NOT NULL THEN '--sampler ' || sampler END, CASE WHEN steps IS NOT NULL THEN '--steps ' || steps END, CASE WHEN seed IS NOT NULL THEN '--seed ' || seed END) AS cli FROM run_requests WHERE action = 'generate'")
def repro_cli(spark: SparkSession, d: str) -> DataFrame:
    """The command line that makes an image again."""
    flag = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"--{c} "), F.col(c).cast("string")))
    backend = F.coalesce(F.lower(F.trim("backend")), F.lit(R.DEFAULT_BACKEND))
    r = table(spark, d, "run_requests").filter("action = 'generate'")
    return r.select("job_id", "received_at", F.concat_ws(" ", F.lit("generate"), F.lit("--backend"), backend, flag("sampler"), flag("steps"), flag("seed")).alias("cli"))


@add("argv_builder", "SELECT id, string_split(argv, ' ')[3] AS script, regexp_extract(argv, '--backend (\\S+)', 1) AS backend, try_cast(regexp_extract(argv, '--n (\\d+)', 1) AS bigint) AS n FROM jobs")
def argv_builder(spark: SparkSession, d: str) -> DataFrame:
    """Script, backend and number back from a job's argv."""
    return table(spark, d, "jobs").select("id", F.get(F.split("argv", " "), F.lit(2)).alias("script"), F.regexp_extract("argv", r"--backend (\S+)", 1).alias("backend"), F.regexp_extract("argv", r"--n (\d+)", 1).try_cast("bigint").alias("n"))
