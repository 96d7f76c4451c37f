"""Strict response parsing on bodies of any size, against json.loads."""

import json
import random

from labelops.operators import batches as B

VALID = ["negative", "neutral", "positive"]


def strict(body):
    try:
        obj = json.loads(body)
    except ValueError:
        return None
    return obj if isinstance(obj, dict) and all(isinstance(v, str) for v in obj.values()) else None


def parsed(spark, bodies):
    df = spark.createDataFrame([(i, 1, b) for i, b in enumerate(bodies)], "batch_no int, attempt int, body string")
    out = [[None, {}] for _ in bodies]
    for r in B.parse_responses(df, VALID).collect():
        out[r.batch_no][0] = r.usable
        if r.key is not None:
            assert r.key not in out[r.batch_no][1]
            out[r.batch_no][1][r.key] = r.label
    return out


def wanted(bodies):
    out = []
    for b in bodies:
        obj = strict(b)
        out.append([obj is not None, {k: v.lower() for k, v in (obj or {}).items() if v.lower() in VALID}])
    return out


def test_long_bodies_neither_crash_nor_differ(spark):
    entries = ",".join(f'"{i}": "{VALID[i % 3]}"' for i in range(20_000))
    escapes = '{"1": "' + "\\n" * 50_000 + '", "2": "positive"}'
    twice = ",".join(f'"{i % 7_000}": "{VALID[i % 3]}"' for i in range(20_000))
    bodies = ["{" + entries + "}", "{" + entries + ",}", "{" + entries, escapes, escapes[:-1], "{" + twice + "}",
              '{"1": "' + "a" * 300_000 + '"}', "{" * 5_000, '{"1": ' + "[" * 5_000 + "]" * 5_000 + "}", " " * 100_000 + "{}"]
    assert parsed(spark, bodies) == wanted(bodies)


def test_random_bodies_agree_with_json(spark):
    rng = random.Random(7)
    atoms = ['"1"', '"2"', '"positive"', '"Neutral"', '"a\\u00e9\\""', '"\\q"', '"\\u12"', '""', ":", ",", "{", "}", " ", "\n", "3", "null", '"x\ty"']
    bodies = ["".join(rng.choices(atoms, k=rng.randint(0, 9))) for _ in range(2_000)]
    for _ in range(2_000):  # mostly right objects with a slip
        body = "{" + ",".join(f'{rng.choice(atoms[:2])}:{rng.choice(atoms[2:8])}' for _ in range(rng.randint(0, 4))) + "}"
        at = rng.randrange(len(body) + 1)
        bodies.append(body[:at] + rng.choice(["", "", "", *atoms]) + body[at:])
    got, want = parsed(spark, bodies), wanted(bodies)
    assert [(b, g) for b, g, w in zip(bodies, got, want) if g != w] == []
    assert sum(w[0] for w in want) > 300


def test_pattern_for_other_engines_gives_the_same_verdicts(spark):
    bodies = ['{"1": "a"}', '{"1": "a\\q"}', "{}", '{"1": "a",}', ' {"1" : "a" , "1":"b"} ', '{"1": 2}', '{"1": "a"}x']
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    rows = df.select(df.body.rlike(B.STRICT_OBJECT).alias("a"), df.body.rlike(B.LINEAR_STRICT_OBJECT).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] == [strict(b) is not None for b in bodies]
