"""Best-fit packing, length buckets: round trips and brute force."""

from collections import Counter
from itertools import combinations

import numpy as np

from daybook.llm import bfd_packing as P
from daybook.llm import length_packing as L


def plain_best_fit(lengths, context):
    room, out = [], {}
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        fits = [x for x in room if x >= lengths[i]]
        if fits:
            at = room.index(min(fits))
            room[at] -= lengths[i]
        else:
            room.append(context - lengths[i])
    return sorted(room)


def test_segment_tree_equals_plain_best_fit():
    r = np.random.default_rng(1)
    for context in (1, 7, 64, 100):
        lengths = r.integers(1, context + 1, 300)
        row, offset, n = P.best_fit(lengths, context)
        used = np.bincount(row, weights=lengths, minlength=n)
        assert sorted((context - used).astype(int)) == plain_best_fit(lengths.tolist(), context)
        for k in range(n):
            at = np.sort(offset[row == k])
            ends = np.sort((offset + lengths)[row == k])
            assert at[0] == 0 and (at[1:] == ends[:-1]).all()


def test_round_trip_of_written_shards(spark, docs, tmp_path):
    folder = f"file://{tmp_path}"
    out = P.pack(docs, folder, context=128, shard_bytes=20_000).toPandas()
    assert out.shard.nunique() > 1
    again = P.pack(docs.repartition(7), folder, context=128, shard_bytes=20_000).toPandas()
    place = ["doc_id", "piece", "start", "n_tokens", "row", "offset"]
    assert out[place].sort_values(place).reset_index(drop=True).equals(again[place].sort_values(place).reset_index(drop=True))
    own = P.encoder(P.vocabulary_path())
    shards = {s: P.read_shard(s, 128) for s in out.shard.unique()}
    got = {}
    for x in out.itertuples():
        matrix, ends, positions = shards[x.shard]
        ids = matrix[x.row, x.offset : x.offset + x.n_tokens]
        assert x.offset in ends[x.row] and x.offset + x.n_tokens in ends[x.row]
        assert positions[x.row, x.offset : x.offset + x.n_tokens].tolist() == list(range(x.n_tokens))
        got.setdefault(None if x.doc_id != x.doc_id else int(x.doc_id), []).append((x.start, ids.tolist()))
    want = {}
    for d in docs.select("doc_id", "text").collect():
        if d.text:
            want.setdefault(d.doc_id, []).append(own.encode_ordinary(d.text))
    assert set(got) == set(want)
    for k, texts in want.items():
        if len(texts) == 1:
            assert sum((ids for _, ids in sorted(got[k])), []) == texts[0]
        else:
            assert sum(len(ids) for _, ids in got[k]) == sum(map(len, texts))


def test_empty_tables(spark, empty, tmp_path):
    assert P.pack(empty, f"file://{tmp_path}").count() == 0
    assert L.pack(empty).count() == 0


def test_bucket_boundaries_are_optimal():
    lengths, counts = [1, 3, 4, 9, 10, 20], [5, 1, 7, 2, 2, 1]
    waste = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))
    for k in (1, 2, 3, 4, 6):
        best = min(waste([*c, 20]) for c in combinations(lengths[:-1], min(k, 6) - 1))
        assert waste(L.boundaries(lengths, counts, k)) == best
    assert L.boundaries([], [], 3) == []


def test_written_batches_hold_every_token_once(docs, tmp_path):
    options = {"context": 64, "buckets": 4, "token_budget": 256}
    packed = L.pack(docs, f"file://{tmp_path}", shard_bytes=4000, **options)
    out = packed.toPandas()
    assert (out.n_tokens <= out.bucket_len).all() and out.bucket_len.nunique() <= 4
    assert not out.duplicated(["shard", "batch", "slot"]).any() and out.shard.nunique() > 4
    own = P.encoder(P.vocabulary_path())
    got = []
    for (shard, batch), rows in out.groupby(["shard", "batch"]):
        width = int(rows.bucket_len.iloc[0])
        ids, lengths = L.read_batch(shard, width, int(batch), token_budget=256)
        assert len(rows) == len(ids) <= max(1, 256 // width) and (rows.bucket_len == width).all()
        for x in rows.itertuples():
            assert lengths[x.slot] == x.n_tokens and not ids[x.slot, x.n_tokens :].any()
            got.append((-1 if x.doc_id != x.doc_id else int(x.doc_id), x.start, tuple(ids[x.slot, : x.n_tokens].tolist())))
    want = []
    for d in docs.select("doc_id", "text").collect():
        ids = own.encode_ordinary(d.text or "")
        want += [(-1 if d.doc_id is None else d.doc_id, at, tuple(ids[at : at + 64])) for at in range(0, len(ids), 64)]
    assert sorted(got) == sorted(want)
    report = {x.bucket_len: x for x in L.padding(packed).collect()}
    assert sum(x.n_padding for x in report.values()) == int((out.bucket_len - out.n_tokens).sum())
    # the boundaries are those of the histogram of these very pieces
    sizes = Counter(len(ids) for _, _, ids in want)
    assert sorted(report) == L.boundaries(list(sizes), list(sizes.values()), 4)
    again = L.pack(docs.repartition(5), f"file://{tmp_path}", shard_bytes=4000, **options).toPandas()
    place = ["doc_id", "start", "n_tokens", "bucket_len", "batch", "slot"]
    assert out[place].sort_values(place).reset_index(drop=True).equals(again[place].sort_values(place).reset_index(drop=True))
