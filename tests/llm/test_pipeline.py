"""Each stage of the pipeline on its own input, against brute force; and the run as a whole."""

import base64
import hashlib
import struct
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_operators import text_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "mix", "bpe"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxicity_only_drops_rows(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert set(after) <= set(before) and len(after) < len(before)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert sum(labels.get(i) == 0 for i in gone) <= 0.1 * max(1, sum(i in labels for i in gone))


def test_line_dedup(stages):
    before = {r.doc_id: r for r in stages[1].collect()}
    pages = Counter(r.source for r in before.values())
    held = Counter((r.source, line) for r in before.values() for line in {x.strip(" ") for x in r.text.split("\n")} - {""})
    for r in stages[2].collect():
        old = before[r.doc_id]
        kept = [x for x in old.text.split("\n") if not x.strip(" ") or not (held[old.source, x.strip(" ")] > 1 and held[old.source, x.strip(" ")] > 0.05 * pages[old.source])]
        assert r.text == "\n".join(kept) and r.n_chars == len(r.text)


def test_one_of_each_near_copy_stays(stages):
    texts = {r.doc_id: r.text for r in stages[2].collect()}
    sets = {}
    for i, t in texts.items():
        w = text_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    least = {i: i for i in texts}
    changed = True
    pairs = [(a, b) for a in texts for b in texts if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(i for i in texts if least[i] == i)


def test_mix_takes_words_of_its_documents(stages):
    whole = {r.doc_id: r for r in stages[3].collect()}
    size, taken = defaultdict(int), defaultdict(int)
    for r in whole.values():
        size[r.source] += len(text_words(r.text))
    for r in stages[4].collect():
        assert not Counter(r.text.split()) - Counter(whole[r.doc_id].text.split())
        taken[r.source] += len(text_words(r.text))
    from wayfold.llm.mix import targets

    order = sorted(size)
    assert [taken[s] for s in order] == [round(t) for t in targets([size[s] for s in order])]


def test_last_stage_encodes(stages):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in stages[4].collect():
        ids = enc.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in stages[5].collect()) == sorted(want)


def test_run_gives_the_stages_result(spark, stages):
    key = ["doc_id", "n_tokens", "ids_sha256"]
    assert rows(corpus_pipeline.run(spark, SF).select(*key)) == rows(stages[-1].select(*key))
