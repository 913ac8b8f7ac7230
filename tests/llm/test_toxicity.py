import random
import zlib

from brindle.llm import queries, toxicity


def test_held_out_accuracy(spark, sf01):
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    rows = queries.op1_toxicity(spark, sf01).collect()
    assert len(rows) == spark.read.parquet(f"{sf01}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    bad, good = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    # few labels here: the dictionaries train on some thirty toxic documents
    assert sum(a > b for a in bad for b in good) / (len(bad) * len(good)) > 0.9
    assert sum(b >= 0.7 for b in good) / len(good) < 0.05


def test_model_learns_words():
    plain = [f"the weather of day {i} was mild and the market of town {i % 7} stayed calm" for i in range(120)]
    toxic = [p.replace("stayed calm", "vile scoundrel" if i % 2 else "scoundrel vile") for i, p in enumerate(plain)]
    model = toxicity.train(toxic, plain).start()
    assert model.score("the town market of that vile scoundrel was mild and calm") > 0.7
    assert model.score("the town market of that day was mild and stayed calm") < 0.3
    assert model.score("") < 0.5
    again = toxicity.train(toxic, plain).start()
    assert again.score("a vile scoundrel") == model.score("a vile scoundrel")


def test_windows_cover_long_words():
    word = "".join(chr(97 + i % 26) for i in range(500))
    parts = toxicity.windows(word)
    assert all(len(p) <= toxicity.WINDOW for p in parts)
    assert all(any(word[i : i + 20] in p for p in parts) for i in range(480))


def test_odd_rows(spark, odd, odd_rows, none, labels):
    rows = toxicity.scored(odd, labels).collect()
    assert len(rows) == len(odd_rows) and all(r.score is not None for r in rows)
    same = {r.score for r in rows if r.doc_id in (1, 2)}
    assert len(same) == 1
    kept = toxicity.without_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= len(odd_rows)
    assert toxicity.scored(none, labels).count() == 0
    assert toxicity.scored(odd, labels.limit(0)).where("predicted = 1").count() == 0


def test_training_reads_whole_texts(spark):
    """What tells of toxicity may come late in a long labelled text."""
    r = random.Random(8)
    plain = ["".join(r.choice("abcdefghijklm") for _ in range(7)) for _ in range(400)]
    rude = ["".join(r.choice("nopqrstuvwxyz") for _ in range(9)) for _ in range(12)]
    prose = lambda n: " ".join(r.choice(plain) for _ in range(n))
    rows = [(i, prose(3000) + " " + (" ".join(r.sample(rude, 5)) if i % 2 else prose(5)), i % 2) for i in range(240)]
    assert all(len(t) > 23_000 for _, t, _ in rows)
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")).start()
    bad = [model.score(prose(3000) + " " + " ".join(r.sample(rude, 5))) for _ in range(20)]
    good = [model.score(prose(3005)) for _ in range(20)]
    assert min(bad) >= toxicity.REJECT_AT > max(good)


def test_scores_come_from_compressed_lengths(spark, sf):
    """Against a plain version: every window of every document compressed with either dictionary, without what the operator remembers."""
    import math

    import numpy as np
    import zstandard as zstd

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.toxic != model.ordinary

    def length(content, window):
        params = zstd.ZstdCompressionParameters(
            format=zstd.FORMAT_ZSTD1_MAGICLESS, strategy=zstd.STRATEGY_GREEDY, min_match=4, window_log=17, hash_log=15, chain_log=16, search_log=8,
            target_length=64, write_checksum=0, write_content_size=0, write_dict_id=0,
        )
        return len(zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params).compress(window))

    saved = {}

    def best(word):
        if word not in saved:
            parts = [word] if len(word) <= 48 else [word[i : i + 48] for i in range(0, len(word) - 24, 24)]
            found = []
            for part in parts:
                raw = part.encode()
                window = toxicity.HEAD + b" " + raw + b" " + toxicity.TAIL
                n = length(model.ordinary, window) - length(model.toxic, window)
                found.append((n, n / (len(raw) + 2)))
            saved[word] = max(found)
        return saved[word]

    def score(text):
        found = [best(w) for w in sorted(set(toxicity.words(text)))]
        top = sorted([n * share for n, share in found if n >= 3 and share > 0], reverse=True)[:3]
        x = [*top, *[0.0] * (3 - len(top)), *[math.log1p(sum(n >= 4 and share >= least for n, share in found)) for least in (0.35, 0.5)], math.log1p(len(found))]
        return 1 / (1 + math.exp(-float(np.append((np.array(x) - model.centre) / model.scale, 1.0) @ model.weights)))

    some = {r.doc_id: r.text for r in docs.where("doc_id % 4 = 0 and length(text) < 3000").collect()}
    rows = [r for r in queries.op1_toxicity(spark, sf).collect() if r.doc_id in some]
    assert rows and all(abs(r.score - score(some[r.doc_id])) < 1e-6 for r in rows)
