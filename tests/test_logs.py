import json
import random

import pytest
from pyspark.sql import functions as F

from embermill.operators import logs

SCHEMA = "job_id bigint, seq bigint, line string, received_at string, chunk int, kind string"
JOBS = "id bigint, started string, ended string, job_id string"


def lines(spark, texts, job=1, start=0):
    return spark.createDataFrame([(job, start + i, t, "2025-01-02", 1, "x") for i, t in enumerate(texts)], SCHEMA).withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))


def jobs(spark, data=((1, "2024-05-01", None, "x"),)):
    df = spark.createDataFrame(list(data), JOBS)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


def parse(spark, texts, **options):
    got = logs.parse_entries(lines(spark, texts), jobs(spark), **options).collect()
    return sorted((r["first_seq"], r["last_seq"], r["ts_ms"], r["level"], r["component"], r["message"]) for r in got)


@pytest.mark.parametrize(
    ("line", "ts", "level", "component"),
    [
        ("2025-01-12 00:00:10,480 - DEBUG - library.scan - x", 1736640010480, "DEBUG", "library.scan"),
        ("2025-01-12T00:00:02.389Z ERR   [sidecar-writer] x", 1736640002389, "ERROR", "sidecar-writer"),
        ("2025-01-12T00:00:02.389Z \x1b[36mWRN  \x1b[0m [decoder] x", 1736640002389, "WARNING", "decoder"),
        ("12-Jan-2025 12:00:06 AM | ERROR | sidecar-writer | x", 1736640006000, "ERROR", "sidecar-writer"),
        ("12-Jan-2025 12:00:06 PM | INFO | a | x", 1736683206000, "INFO", "a"),
        ("[2025/01/12 00:00:11] [C] [loader] x", 1736640011000, "CRITICAL", "loader"),
        ("I0112 01:30:45.509786  51775 mem_pool.cc:261] x", 1705023045509, "INFO", "mem_pool.cc"),
        ("F0229 00:00:00.000001  1 a.cc:1] x", 1709164800000, "CRITICAL", "a.cc"),
        ("WARNING:studio.queue:x", -1, "WARNING", "studio.queue"),
        ("[film] ERROR: x", -1, "ERROR", "film"),
        ("[flux-refine]   step 25: ERROR: x", -1, "NONE", "flux-refine"),
        ('time=2025-01-12T05:30:38+05:30 comp=backend.sdxl level=crt msg="level=info comp=b"', 1736640038000, "CRITICAL", "backend.sdxl"),
        ('time=2025-01-11T19:01:12-0500 level=info comp=a msg="x"', 1736640072000, "INFO", "a"),
        ('{"time": 1736640001.4979, "severity": 30, "logger": "a.b", "message": "x"}', 1736640001497, "WARNING", "a.b"),
        ('{"msg": "a \\" b", "extra": {"level": "error", "name": "z"}, "ts": "2025-01-12T00:00:10.463Z", "lvl": "inf", "name": "q"}', 1736640010463, "INFO", "q"),
    ],
)
def test_heads(spark, line, ts, level, component):
    assert [r[:5] for r in parse(spark, [line])] == [(0, 0, ts, level, component)]


@pytest.mark.parametrize("line", ["[1/3] resizing", "  [film] x", "ERROR: no component", "Traceback (most recent call last):", "KeyError: 'x'", "diagonal | 0.6 | 9", " 45%|####  | 9/20", "\r 45%|##", "}", "", None, "see above; x", "[info] x", "{", "x" * 100_000])
def test_other_lines_belong_to_the_entry_before(spark, line):
    expected = (0, 1) if line != "{" else (0, 0)
    got = parse(spark, ["[film] x", line])
    assert got[0][:2] == expected and len(got) == 1 + (line == "{")


def test_records_over_several_lines(spark):
    record = ["{", '  "ts": "2025-01-12T00:00:31.717Z",', '  "severity": "dbg",', '  "detail": {', '    "level": "error",', '    "name": "z"', "  },", '  "name": "sampler.pca",', '  "msg": "decoded"', "}"]
    after = ["  {", '    "level": "error"', "  }"]
    got = parse(spark, ["lost beginning", *record, *after, "[film] y"])
    assert got == [(1, 13, 1736640031717, "DEBUG", "sampler.pca", "decoded\n" + "\n".join(after)), (14, 14, -1, "NONE", "film", "y")]


def test_chunks_make_no_difference(spark):
    rng = random.Random(3)
    kinds = [
        lambda i: [f"2025-01-12 00:00:10,{i % 1000:03d} - INFO - a.b - m{i}"],
        lambda i: ["[gen] x", "    more", None, "Traceback (most recent call last):"],
        lambda i: json.dumps({"time": "2025-01-12T00:00:31.717Z", "level": "err", "component": "c", "note": {"level": "x"}, "msg": f"m{i}"}, indent=2).split("\n"),
        lambda i: ["free text"] * rng.randint(1, 30),
    ]
    texts = ["cut off"] * 9 + [x for i in range(150) for x in rng.choice(kinds)(i)]
    whole = parse(spark, texts)
    for size in (1, 7, 64):
        assert parse(spark, texts, chunk_lines=size) == whole


def test_dirt(spark):
    base = ["[film] a", "more", "[gen] b"]
    twice = lines(spark, base).unionByName(lines(spark, base))
    odd = spark.createDataFrame([(None, 1, "[film] a", None, 1, "x"), (1, None, "[film] a", None, 1, "x"), (2, 5, "no head", None, 1, "x"), (3, 0, "I0112 00:00:00.5 1 a.cc:1] x", "2023-01-01", 1, "x")], SCHEMA).withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))
    got = logs.parse_entries(twice.unionByName(odd).repartition(5), jobs(spark), with_message=False).collect()
    # job 3 is unknown, so the year is that of its lines
    assert sorted((r["job_id"], r["first_seq"], r["last_seq"], r["ts_ms"]) for r in got) == [(1, 0, 1, -1), (1, 2, 2, -1), (3, 0, 0, 1673481600500)]
    assert logs.parse_entries(lines(spark, base).limit(0), jobs(spark).limit(0)).collect() == []


def test_templates_are_mined(spark):
    texts = [f"2025-01-12 00:00:{i % 60:02d},480 - INFO - {c} - step {i}" for i in range(40) for c in ("a.b", "c.d")] + ["[film] x", "free text"]
    heads = logs.count_heads(lines(spark, texts))
    mined = logs.mine_templates(heads, 0.05)
    assert mined.templates == {"ymd space clock space - space level_upper space - space component space -".replace(" ", "\x1f"): 80}
    assert logs.mine_templates(heads.limit(0)) == logs.Mined()


def test_a_frequent_layout_that_no_rule_lists_is_mined(spark, monkeypatch):
    texts = [f"<{level}> 12:00:{i % 60:02d}.{i:03d} 2024-03-08 worker-{i % 7} >> did step {i}" for i in range(250) for level in ("INFO", "WARN")]
    texts += ["Traceback (most recent call last):", "  in a.py", "KeyError: 'x'"]
    got = parse(spark, texts)
    assert len(got) == 500 and got[-1][:2] == (499, 502)
    assert got[3][:5] == (3, 3, 1709899201001, "WARNING", "worker-1") and got[3][5] == "did step 1"
    monkeypatch.setattr(logs, "mine_templates", lambda heads, support: logs.Mined())
    assert parse(spark, texts) == []  # what isn't mined is left to rules that believe only the common


def test_roles_come_from_the_counts(spark):
    """The same shape of line, once with few names before the colon, once with ever new ones; keys with unknown names."""
    named = [f"2024-03-08 12:00:00 {('scanner', 'decoder')[i % 2]}: m{i}" for i in range(200)]
    new = [f"2024-03-08 12:00:00 {chr(97 + i % 26)}{chr(97 + i // 26)}x: m{i}" for i in range(200)]
    assert {r[4] for r in parse(spark, named)} == {"scanner", "decoder"} and len(parse(spark, named)) == 200
    heads = logs.count_heads(lines(spark, new))
    assert logs.mine_templates(heads).templates == {}
    keyed = [f'at=2024-03-08T12:00:00Z sev={("info", "err")[i % 2]} part={("queue", "vae")[i % 2]} text="m {i}"' for i in range(100)]
    got = parse(spark, keyed)
    assert len(got) == 100 and {r[2:5] for r in got} == {(1709899200000, "INFO", "queue"), (1709899200000, "ERROR", "vae")}


def test_mining_makes_a_difference_on_the_tables(spark, data, monkeypatch):
    args = spark.read.parquet(f"{data}/log_lines.parquet"), spark.read.parquet(f"{data}/jobs.parquet"), False
    whole = logs.parse_entries(*args).count()
    monkeypatch.setattr(logs, "mine_templates", lambda heads, support: logs.Mined())
    assert logs.parse_entries(*args).count() < whole


def test_one_job_with_all_lines_is_spread(spark):
    """No chunk of a job is larger than its bound, whatever the job's size."""
    texts = [f"2025-01-12 00:00:10,480 - INFO - a.b - m{i}" if i % 3 == 0 else "more" for i in range(3000)]
    got = logs.parse_entries(lines(spark, texts), jobs(spark), with_message=False, chunk_lines=100)
    assert got.count() == 1000 and got.filter("last_seq - first_seq <> 2").count() == 0


@pytest.mark.parametrize(
    ("head", "ts", "level", "component"),
    [
        ("2025-01-12 00:00:10 [INFO] film.loop: ", 1736640010000, "INFO", "film.loop"),
        ("[2025-01-12T00:00:10Z] worker-3 <WARN> decoder[71]: ", 1736640010000, "WARNING", "decoder"),
        ("May 12 00:00:10 host-a scanner[12]: ", 1715472010000, "NONE", "scanner"),
    ],
)
def test_frequent_heads_outside_the_grammar_are_mined(spark, head, ts, level, component):
    texts = [head + f"step {i} done" for i in range(20)] + [head + "seldom said", "  indented", "and not a head: x"]
    got = parse(spark, texts)
    assert [g[:5] for g in got] == [(i, i if i < 20 else 22, ts, level, component) for i in range(21)]
