"""Pseudo-code over blocks, columns and pages, against a loop over the rows."""

import random
import re

from vellum.operators import page_code as pc

LINES = "doc_id int, page int, block int, place int, line int, x0 double, y0 double, x1 double, y1 double, text string, bold boolean, holds boolean"
RULES = "doc_id int, page int, x0 double, y0 double, x1 double, y1 double"
CODE = ["for each item do", "x ← 1", "return x", "end if", "while a == b", "step 3: go"]
TEXTS = [*CODE, *CODE, *CODE, *CODE, "a short remark", "Prose that goes on for much longer than any row of code would go on here", "Figure 3. What it does", "  ", None]


def loop(blocks, rules, body):
    """(page, block, first line) -> (code, indent) by going through the blocks."""
    out, n, last, em = {}, 0, None, max(6.0, body)
    for b in blocks:
        lines = [x for x in b["lines"] if x["text"] and x["text"].strip()]
        if not lines:
            continue
        if not b["holds"]:
            last = None
            continue
        if re.match(r"Algorithm \d+:", lines[0]["text"]):
            h, n = lines[0], n + 1
            below = sorted(r["y0"] for r in rules if r["page"] == b["page"] and r["y1"] - r["y0"] < 2.5 and r["x1"] - r["x0"] > 60 and h["x0"] - 50 <= r["x0"] <= h["x0"] + 20 and r["y0"] > max(h["y0"], h["y1"] - 1))
            stop = below[1] + 1 if len(below) > 1 else below[0] + 1 if below and below[0] > h["y1"] + body * 2 else None
            last = {"n": n, "stop": stop, "y": h["y1"], "x": None, "rows": []}
            out[b["page"], b["block"], h["line"]] = (n, None)
            lines = lines[1:]
        if last is None:
            continue
        rows = []
        for x in sorted(lines, key=lambda x: (round(x["y1"]), x["x0"])):
            if rows and abs(rows[-1][-1]["y1"] - x["y1"]) < 2.5 and x["x0"] >= rows[-1][-1]["x0"]:
                rows[-1].append(x)
            else:
                rows.append([x])
        for row in rows:
            text = " ".join(x["text"].strip() for x in row)
            free = last["stop"] is None
            coded = any(c in text for c in CODE) or bool(re.match(r"\d+:", text))
            if (not free and row[0]["y0"] > last["stop"]) or (free and row[0]["y0"] - last["y"] > em * 1.6) or text.startswith("Figure") or (free and not coded and len(text) > 60):
                last = None
                break
            at = row[1]["x0"] if len(row) > 1 and re.fullmatch(r"\d+:", row[0]["text"].strip()) else row[0]["x0"]
            if last["x"] is None or at < last["x"]:
                shift = round((last["x"] - at) / (em * 1.2)) if last["x"] is not None else 0
                for k in last["rows"]:
                    out[k] = (out[k][0], out[k][1] + shift)
                last["x"] = at
            key = b["page"], b["block"], row[0]["line"]
            out[key] = (last["n"], max(0, round((at - last["x"]) / (em * 1.2))))
            last["rows"].append(key)
            last["y"] = row[-1]["y1"]
    return out


def page_lines(rng, doc):
    blocks, rules, number = [], [], 0
    for page in range(rng.randint(1, 4)):
        y = 50.0
        for block in range(rng.randint(1, 6)):
            y = 50.0 if rng.random() < 0.15 else y + rng.choice([2, 6, 20])
            lines, k = [], 0
            if rng.random() < 0.4:
                number += 1
                lines.append(dict(line=0, x0=60.0, y0=y, y1=y + 10, text=f"Algorithm {number}: Search"))
                for d in rng.choice([[], [2], [30], [2, 55], [3, 20, 70], [100]]):
                    rules.append(dict(page=page, x0=55.0 + rng.choice([0, 0, 100]), x1=300.0, y0=y + 10 + d, y1=y + 10 + d + rng.choice([0, 1, 4])))
                y, k = y + 12, 1
            for _ in range(rng.randint(0, 7)):
                x, text = 70.0 + 6 * rng.randrange(8), rng.choice(TEXTS)
                if rng.random() < 0.4:
                    lines.append(dict(line=k, x0=50.0, y0=y, y1=y + 10 + rng.choice([0, 1]), text=f"{k}:"))
                    k += 1
                lines.append(dict(line=k, x0=x, y0=y, y1=y + 10, text=text))
                k += 1
                y += rng.choice([12, 12, 12, 12, 40])
            blocks.append(dict(page=page, block=block, holds=rng.random() > 0.1, lines=lines))
    return blocks, rules


def test_against_a_loop(spark):
    rng = random.Random(8)
    lines, rules, want = [], [], {}
    for d in range(120):
        blocks, own = page_lines(rng, d)
        for place, b in enumerate(blocks):
            lines += [(d, b["page"], b["block"], place, x["line"], x["x0"], x["y0"], x["x0"] + 40, x["y1"], x["text"], None, b["holds"]) for x in b["lines"]]
        rules += [(d, r["page"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in own]
        want[d] = [(*k[:2], *v) for k, v in loop(blocks, own, 10.0).items()]
    rng.shuffle(lines)
    given = spark.createDataFrame(lines, LINES).repartition(4)
    got = {}
    for r in pc.sessions(given, spark.createDataFrame(rules, RULES)).where("code IS NOT NULL").collect():
        got.setdefault(r["doc_id"], []).append((r["page"], r["block"], r["code"], r["indent"]))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    for d, w in want.items():
        assert sorted(got.get(d, []), key=key) == sorted(w, key=key), d
    assert sum(map(len, want.values())) > 500
    assert any(len({p for p, _, code, _ in w if code == c}) > 1 for w in want.values() for c in {x[2] for x in w})  # over pages


def test_nothing(spark):
    none = pc.sessions(spark.createDataFrame([], LINES), spark.createDataFrame([], RULES))
    assert none.count() == 0 and none.columns == ["doc_id", "page", "block", "row", "head", "text", "code", "indent"]


def test_texts_are_cut_in_one_go(spark, tmp_path):
    """A row for each piece with the whole text in it takes the square of a text's length; each text is read twice, for lines and rules."""
    from pyspark.sql import functions as F

    from vellum.plans.pages import page_code_sessions

    text = F.concat(*[F.lit(x) for x in ("éx <- 1\n", "for each word, do ")])
    spark.range(3).select(F.col("id").alias("doc_id"), F.repeat(text, 40).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    found = page_code_sessions(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2
    assert not any("explode(sequence(" in line for line in plan.splitlines())
    assert found.count() > 0
