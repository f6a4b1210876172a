"""The whole pipeline against a brute-force version of its stages, each on what the stage before it kept."""

import re
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from prismer.llm import line_dedup, toxicity
from prismer.llm.common import table
from prismer.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
MAIL = re.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+[A-Za-z]")


def classes(n, linked):
    """The smallest member of each member's class."""
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(n)]


def without_repeated_lines(texts):
    """Texts by doc_id without lines within two edits of an earlier one; those left without text go."""
    places = [(d, k, x) for d in sorted(texts) for k, x in enumerate((texts[d] or "").split("\n")) if len(x) >= line_dedup.SHORTEST]
    lines = list(dict.fromkeys(x for *_, x in places))
    by_line = dict(zip(lines, classes(len(lines), lambda i, j: abs(len(lines[i]) - len(lines[j])) <= 2 and line_dedup.within(lines[i], lines[j], 2))))
    first, gone = {}, defaultdict(set)
    for d, k, x in places:
        if first.setdefault(by_line[x], (d, k)) != (d, k):
            gone[d].add(k)
    left = {d: t if d not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in texts.items()}
    return {d: t for d, t in left.items() if d not in gone or t.strip(" ")}


def one_of_each(texts):
    """doc_ids of the least of each class of texts whose five-word shingles are alike by 0.8 or more."""
    ids, sets = sorted(texts), []
    for d in ids:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), texts[d] or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = classes(len(ids), lambda i, j: sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    return {d for i, d in enumerate(ids) if root[i] == i}


def test_pipeline(spark, monkeypatch):
    frames, save = [], corpus_pipeline.saved
    monkeypatch.setattr(corpus_pipeline, "saved", lambda df: frames.append(save(df)) or frames[-1])
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = table(spark, SF, "documents")
    assert len(frames) == 4 and all(f.columns == docs.columns for f in frames)
    calm, thin, alone, private = ({r.doc_id: r.text for r in f.collect()} for f in frames)

    scores = toxicity.score(docs, toxicity.fit(docs, table(spark, SF, "labels"))).select("doc_id", "text", "score").collect()
    assert calm == {r.doc_id: r.text for r in scores if r.score < 0.5}
    assert thin == without_repeated_lines(calm)
    assert alone == {d: thin[d] for d in one_of_each(thin)}
    assert private.keys() == alone.keys()
    found = {m for t in alone.values() for m in MAIL.findall(t or "")}
    assert not any(m in (t or "") for m in found for t in private.values())

    encode = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")).encode
    pieces, places, sizes = defaultdict(list), defaultdict(list), []
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == private.keys()
    for d, t in private.items():
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for i, (piece, start, length, crc) in enumerate(sorted(pieces[d])):
            assert (piece, start, crc) == (i, at, zlib.crc32(ids[at : at + length].tobytes())) and (length == 2048 or i == 0 or at + length == len(ids))
            at += length
            sizes.append(length)
        assert at == len(ids) and len(pieces[d]) == -(-len(ids) // 2048)
    for place in places.values():
        ends = np.cumsum([0, *[n for _, n in sorted(place)]])
        assert [o for o, _ in sorted(place)] == ends[:-1].tolist() and ends[-1] <= 2048
    free = []
    for n in sorted(sizes, reverse=True):
        fits = [i for i, x in enumerate(free) if x >= n]
        if fits:
            free[min(fits, key=free.__getitem__)] -= n
        else:
            free.append(2048 - n)
    assert len(places) <= len(free)


def test_stages_of_odd_tables(spark):
    """Every stage on an empty table and on nulls, empty and long texts, repeated rows and extra columns of clashing names."""
    long = " ".join(f"w{i * i % 977}" for i in range(60_000))
    near = " ".join(f"v{i}" for i in range(200))
    texts = [(1, None), (2, ""), (3, long), (4, near), (5, near + " end"), (6, "one line of text that comes twice\none line of text that comes twice"), (6, "one line of text that comes twice\none line of text that comes twice"), (None, "no id here but a text"), (7, "  ")]
    kind = "doc_id long, text string, source string, n_chars long, score string, n_dropped int, w int, th long, _found array<int>, component_id string"
    odd = spark.createDataFrame([(i, t, None, len(t or ""), "s", 7, 8, 9, [1], "c") for i, t in texts], kind)
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd.limit(0), SF).collect() == []
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns
        rows[name] = got.collect()
        assert all((r.source, r.score, r.n_dropped, r.w, r.th, r["_found"], r.component_id) == (None, "s", 7, 8, 9, [1], "c") and r.n_chars == len(r.text or "") for r in rows[name])
    ids = {name: sorted(r.doc_id or 0 for r in found) for name, found in rows.items()}
    assert ids["toxicity"] == ids["PII"] == [0, 1, 2, 3, 4, 5, 6, 6, 7]
    assert ids["line dedup"] == [0, 1, 2, 3, 4, 5, 6, 6, 7] and ids["n-gram Jaccard join"] == [0, 1, 2, 3, 4, 6, 6, 7]
    assert [r.text for r in rows["line dedup"] if r.doc_id == 6] == ["one line of text that comes twice"] * 2
    assert sorted((r.doc_id or 0, r.text) for r in rows["PII"] if r.text is not None) == sorted((i or 0, t) for i, t in texts if t is not None)
    packed = corpus_pipeline.STAGES[-1][1]
    assert packed(spark, odd.limit(0), SF).collect() == []
    assert sorted(r.doc_id or 0 for r in packed(spark, odd, SF).where("start = 0").collect()) == [0, 1, 2, 3, 4, 5, 6, 6, 7]
