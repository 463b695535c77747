"""Lines of any length in op8 and the pipeline, also of scripts without spaces, against brute force."""

import random
import re

import corpus_pipeline
from staylens.llm import line_dedup, queries

UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u9fff\uf900-\ufaff\U00020000-\U00033fff"
WORD = re.compile(f"[{UNSPACED}]|[^\x20\x09-\x0d{UNSPACED}]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
    return row[-1]


def expected(texts):
    lines = [((i, n), tuple(WORD.findall(x)), x) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n"))]
    first = {}
    for place, w, _ in lines:
        first.setdefault(w, place)
    near = {w for w, p in first.items() if len(w) > 1 and any(q < p and len(v) > 1 and abs(len(v) - len(w)) < 2 and distance(w, v) == 1 for v, q in first.items())}
    kept = {i: [] for i in range(len(texts))}
    for place, w, x in lines:
        if not w or first[w] == place and w not in near:
            kept[place[0]].append(x)
    return {i: "\n".join(v) for i, v in kept.items()}


def made():
    r = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    han, thai = [chr(0x4E00 + i * 7) for i in range(300)], [chr(0x0E01 + i) for i in range(40)]
    texts = []
    for _ in range(50):
        lines = ["All rights reserved."] if r.random() < 0.3 else []
        lines += [" ".join(r.choices(words, k=r.randint(1, 9))) for _ in range(r.randint(0, 3))]
        lines += ["".join(r.choices(r.choice([han, thai]), k=r.randint(1, 40))) for _ in range(r.randint(0, 2))]
        lines += [r.choice(["", " ", "mixed 漢字 and ไทย words𠀀x"])]
        texts.append("\n".join(lines))
    pool = [x for t in texts for x in t.split("\n") if len(WORD.findall(x)) > 3]
    for x in r.sample(pool, 20):
        cut = r.randrange(len(x))
        texts.append(x + "\n" + x[:cut] + "漢" + x[cut + 1 :])
    return texts


def test_lines_of_any_length(spark, sf_dir, tmp_path):
    texts = made()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    want = expected(texts)
    got = {x.doc_id: x.text for x in line_dedup.removal(docs, min_words=1, fuzzy_words=2, bundle_bytes=700).collect()}
    assert got == want
    left = {x.doc_id: x.text for x in corpus_pipeline.repeated_lines(spark, docs, sf_dir).collect()}
    assert left == {i: t for i, t in want.items() if t.strip() or t == texts[i]}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()
    assert sum(x.n_removed for x in rows) == sum(t.count("\n") + 1 for t in texts) - sum(0 if not t and texts[i] else t.count("\n") + 1 for i, t in want.items())
