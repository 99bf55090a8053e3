"""The pipeline stage by stage against plain Python, each stage on its own input; and what the registered queries return."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import pytest
import sentencepiece
from lodestone.llm import mixing, pieces, quality, queries, toxicity
from lodestone.llm.common import table
from test_native import spans_of
from test_near_dedup import classes

SMALL = "/root/testdata/sf0.001"


def redacted(text: str | None) -> str | None:
    out, at = [], 0
    for a, _, b in spans_of(text or ""):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return text if text is None else "".join(out) + text[at:]


def check_toxicity(spark, before, after):
    model = toxicity.train(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    scores = toxicity.score([r.text or "" for r in before], model)
    assert Counter(after) == Counter(r for r, s in zip(before, scores) if s < corpus_pipeline.TOXIC)
    toxic = {r.doc_id for r in table(spark, SMALL, "labels").where("toxic = 1").collect()}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert len(gone & toxic) >= 0.8 * len(toxic & {r.doc_id for r in before}) and len(gone - toxic) <= 0.1 * len(before)


def check_near_dedup(spark, before, after):
    found = classes({r.doc_id: r.text or "" for r in before})
    assert Counter(after) == Counter(r for r in before if found[r.doc_id] == r.doc_id)


def check_secrets(spark, before, after):
    assert Counter((r.doc_id, r.source, r.text, r.n_chars) for r in after) == Counter((r.doc_id, r.source, t, None if t is None else len(t)) for r in before for t in [redacted(r.text)])


def check_mixing(spark, before, after):
    times, size, taken = Counter(after), Counter(), Counter()
    assert set(times) <= set(before) and max(times.values()) <= 3
    for r in before:
        n = len(re.findall(mixing.WORD, r.text or ""))
        size[r.source], taken[r.source] = size[r.source] + n, taken[r.source] + n * times[r]
    left, want = sorted(size, key=lambda s: (s is None, s)), {}
    weight = {s: mixing.WEIGHTS[n % 3] for n, s in enumerate(left)}
    while left:
        share = (sum(size.values()) - sum(want.values())) / sum(weight[s] for s in left)
        over = {s for s in left if share * weight[s] > 3 * size[s]}
        want |= {s: 3 * size[s] for s in over} or {s: share * weight[s] for s in left}
        left = [s for s in left if s not in want]
    # A source of a few documents can miss by up to half of its smallest one.
    least = {s: min(len(re.findall(mixing.WORD, r.text or "")) for r in before if r.source == s) for s in want}
    for s in want:
        sizes = [(len(re.findall(mixing.WORD, r.text or "")), times[r]) for r in before if r.source == s]
        assert abs(taken[s] - want[s]) <= max(0.1 * want[s] + 5, least[s] / 2), (s, taken[s], want[s], sizes)


def check_pieces(spark, before, after):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = Counter((r.doc_id, r.source, None if r.text is None else tuple(model.encode(r.text))) for r in before)
    assert Counter((r.doc_id, r.source, None if r.piece_ids is None else tuple(r.piece_ids)) for r in after) == want
    assert all(r.piece_ids is None or r.n_pieces == len(r.piece_ids) for r in after)


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, SMALL))
        if name != "pieces":
            assert out.columns == docs.columns, name
        globals()[f"check_{name}"](spark, docs.collect(), out.collect())
        docs = out


def test_stages_of_empty_and_odd_documents(spark):
    schema = table(spark, SMALL, "documents").schema
    for rows in ([], [(1, None, None, None, None), (1, None, None, None, None), (None, "a secret = abcdefgh12", "xx", "s", 3), (2, "", "en", None, 0), (3, "word " * 40_000, "en", "s", 200_000)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, SMALL))
        assert docs.count() >= bool(rows)


#: What the contracts name, with types.
CONTRACTS = {
    "op1_histogram_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_nb_ngram_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_permutation_search": "query_id bigint, rank int, vec_id bigint, score double",
    "op4_rule_ensemble_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_pareto_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_template_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op7_maxplus_pieces": "doc_id bigint, piece_ids array<int>",
    "op8_bagminhash_dedup": "doc_id bigint, class_id bigint",
    "op9_trigram_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op10_multi_index_duplicates": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op11_vector_file_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_closed_syncmers": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op13_bitmap_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_registered_queries_keep_their_contracts(spark, name):
    found = queries.QUERIES[name](spark, SMALL)
    types = {f.name: f.dataType.simpleString() for f in found.schema}
    assert {c.split()[0]: types.get(c.split()[0]) for c in CONTRACTS[name].split(", ")} == dict(c.split() for c in CONTRACTS[name].split(", "))
    if name.startswith(("op11", "op13")):
        return  # their rows are held against plain Python and SQL
    rows, source = found.collect(), "embeddings" if name.startswith(("op3", "op10")) else "documents"
    ids = [r.doc_id if source == "documents" else r.vec_id for r in table(spark, SMALL, source).collect()]
    if name.startswith("op3"):
        queried = [i for i in ids if i is not None and i % 20 == 0]
        assert Counter(r.query_id for r in rows) == Counter({i: min(20, len(ids) - 1) * n for i, n in Counter(queried).items()})
        assert all(r.query_id != r.vec_id for r in rows)
    else:
        assert Counter(r["doc_id" if source == "documents" else "vec_id"] for r in rows) == Counter(ids)
    if "predicted" in types:
        least = 0.5 if name.startswith("op2") else 0.3
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= least) for r in rows)
    if name.startswith("op1_"):
        for shard in {r.shard for r in rows}:
            slots = sorted(r.slot for r in rows if r.shard == shard)
            assert 0 <= shard < 40 and slots == list(range(len(slots)))
    if name.startswith("op5"):
        assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    if name.startswith("op7"):
        assert all(r.round_trip for r in rows)
    if name.startswith("op10"):
        assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_quality_is_learnt_without_ids_or_sources():
    assert {"doc_id", "source", "lang"}.isdisjoint(quality.STATS)
