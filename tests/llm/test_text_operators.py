"""Brute force, awkward rows, hot groups and literal cases for each text operator."""

import random

import brute
import odd
import pytest
from pyspark.sql import functions as F

from tabletrust.llm import (
    decontaminate,
    line_crf,
    line_dedup,
    line_rules,
    link_trust,
    ngram_join,
    pieces,
    suffix_dedup,
    token_counts,
    tool_calls,
)


@pytest.fixture(scope="module")
def docs(spark):
    return odd.documents(spark).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def pairs(rows=odd.TEXTS):
    return [(r[0], r[1]) for r in rows]


def same(df, expected):
    assert odd.plain(df) == sorted(expected, key=repr)


def mixed(seed=7, n=160):
    """Random texts with copies, near copies, chains of near copies, and shared passages and lines."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passage, line, base = text(70), text(6), text(60).split()
    out = []
    for i in range(n):
        kind = r.randrange(7)
        if kind == 0:
            t = text(r.randint(1, 12))
        elif kind == 1:
            t = text(40) + "\n" + passage + "\n" + text(30)
        elif kind == 2:
            changed = list(base)
            for _ in range(r.randint(0, 3)):
                changed[r.randrange(len(base))] = word()
            t = " ".join(changed)
        elif kind == 3 and out:
            t = r.choice(out)[1]
        elif kind == 4 and out:
            t = (r.choice(out)[1] or "") + " " + word()
        elif kind == 5:
            t = text(25) + "\n  " + line.upper() + "\t\n" + text(25)
        else:
            t = text(r.randint(5, 90))
        out.append((i * 3, t))
    r.shuffle(out)
    return out


# Suffix dedup


def test_suffix_brute_force(spark):
    rows = mixed()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    same(suffix_dedup.report(frame), brute.suffix(rows))


def test_suffix_over_many_chunks(spark, monkeypatch):
    rows = mixed(11, 60)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = odd.plain(suffix_dedup.repeated_spans(frame))
    assert odd.plain(suffix_dedup.repeated_spans(frame, chunk_bytes=2_000)) == whole
    small = suffix_dedup.repeated_spans(frame, chunk_bytes=2_000, range_bytes=500, hot_docs=1)
    assert odd.plain(small) == whole


def test_a_hot_anchor_is_spread_over_ranges():
    import numpy as np
    import pyarrow as pa

    from tabletrust.llm import chunks

    r = random.Random(5)

    def noise():
        return "".join(r.choice("abcdefghij ") for _ in range(30))

    line = "This boilerplate line is forty-five bytes ok."
    texts = [(i, noise() + line + noise()) for i in range(400)]
    rows = pa.table(
        {"chunk": pa.array([0] * 400, pa.int32()), "doc_id": [i for i, _ in texts], "text": [t for _, t in texts]}
    )
    keys = np.sort(chunks.short(np.concatenate(list(suffix_dedup.anchors(chunks.texts_of(rows))))))
    keys, counts = np.unique(keys, return_counts=True)
    keys, counts = keys[counts > 1], counts[counts > 1]
    shared = chunks.table_of(
        [(0, chunks.pack(keys), counts.astype(np.uint32).tobytes())], chunks._SHARED
    )

    def largest(hot_docs):
        asked = suffix_dedup._ask(4096, hot_docs)(rows, shared).to_pylist()
        return max(len(a["docs"]) for a in asked) / sum(len(a["docs"]) for a in asked)

    assert largest(100) < 0.01 < largest(10**6)
    told = suffix_dedup._ask(4096, 100)(rows, shared)
    told = [suffix_dedup._tell(told.slice(i, 1)) for i in range(told.num_rows)]
    heard = pa.concat_tables([*told, shared], promote_options="default")
    got = suffix_dedup._cut(4096, 100)(rows, heard).to_pylist()
    removed = sorted((x["doc_id"], sum(x["ends"]) - sum(x["starts"])) for x in got)
    assert removed == sorted((x[0], x[2]) for x in brute.suffix(texts))


def test_chunks_grow_with_the_root_of_the_input():
    from tabletrust.llm import chunks

    base = chunks.LEAST_INPUT
    assert chunks.chunk_count(0) == 1
    assert chunks.chunk_count(base) == base // chunks.CHUNK_BYTES
    assert chunks.chunk_count(100 * base) == 10 * chunks.chunk_count(base)
    most = 10**6 * base / chunks.chunk_count(10**6 * base)
    assert most <= chunks.MOST_CHUNK_BYTES


def test_suffix_odd_rows(docs, nothing):
    got = suffix_dedup.report(docs)
    with_id = [(i, t) for i, t in pairs() if i is not None]
    same(got.where("doc_id is not null"), brute.suffix(with_id))
    assert got.where("doc_id is null").count() == 2
    assert suffix_dedup.report(nothing).count() == 0


def test_long_texts_are_cut_into_blocks_without_loss(monkeypatch):
    r = random.Random(3)
    text = bytes(r.choice(b"abcd ") for _ in range(30_000))
    whole = {(int(k), int(p)) for b in suffix_dedup.blocks([text]) for k, p in zip(b.key, b.anchor - b.base)}
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1_000)
    parts = list(suffix_dedup.blocks([text]))
    assert len(parts) > 20
    assert whole == {(int(k), int(p)) for b in parts for k, p in zip(b.key, b.anchor - b.base)}


def test_suffix_answers_do_not_depend_on_the_order_of_a_chunks_rows():
    import numpy as np
    import pyarrow as pa

    from tabletrust.llm import chunks

    texts = mixed()
    rows = pa.table(
        {"chunk": pa.array([0] * len(texts), pa.int32()), "doc_id": [r[0] for r in texts], "text": [r[1] for r in texts]}
    )
    keys = np.concatenate(list(suffix_dedup.anchors(chunks.texts_of(rows))))
    keys = chunks.distinct(chunks.short(keys))
    ones = np.ones(len(keys), np.uint32)
    shared = chunks.table_of([(0, chunks.pack(keys), ones.tobytes())], chunks._SHARED)
    asked = suffix_dedup._ask(3)(rows, shared)
    told = [suffix_dedup._tell(asked.slice(i, 1)) for i in range(asked.num_rows)]
    heard = pa.concat_tables([*told, shared], promote_options="default")
    cut = suffix_dedup._cut(3)
    expected = sorted((x[0], x[2]) for x in brute.suffix(texts))
    for seed in range(4):
        order = list(range(len(texts)))
        if seed:
            random.Random(seed).shuffle(order)
        got = cut(rows.take(order), heard).to_pylist()
        removed = [(r["doc_id"], sum(r["ends"]) - sum(r["starts"])) for r in got]
        assert sorted(removed) == expected


def test_run_index_compresses_repetition():
    import numpy as np

    r = random.Random(1)
    base = bytes(r.choice(b"acgt") for _ in range(200))
    segments = [bytes([65 + i]) * 5 + base for i in range(20)]
    index = suffix_dedup.RunIndex(segments, np.arange(20))
    assert index.n_runs < index.n_suffixes / 3
    assert index.window_docs.reshape(20, -1)[:, 5:].max() == 0


def test_run_index_streams_every_window_to_its_smallest_document():
    import numpy as np

    r = random.Random(4)
    for letters, longest in ((b"a", 80), (b"ab", 76), (bytes([0, 255, 97]), 120)):
        pool = bytes(r.choice(letters) for _ in range(300))
        cuts = [(r.randrange(0, 180), r.randrange(50, longest)) for _ in range(150)]
        segments = sorted({pool[a : a + n] for a, n in cuts})
        r.shuffle(segments)
        least = np.array([r.randrange(1000) for _ in segments])
        index = suffix_dedup.RunIndex(segments, least)
        windows = [(s[i : i + 50], d) for s, d in zip(segments, least.tolist()) for i in range(len(s) - 49)]
        smallest = {}
        for w, d in windows:
            smallest[w] = min(d, smallest.get(w, d))
        assert index.window_docs.tolist() == [smallest[w] for w, _ in windows]


def test_windows_are_ranked_by_their_bytes_wherever_they_lie():
    import numpy as np

    r = random.Random(9)
    for letters in (b"a", b"ab", bytes(range(256))):
        segments = [bytes(r.choice(letters) for _ in range(r.randrange(50, 77))) for _ in range(60)]
        segments += [segments[0][5:] + b"aaaaab", bytes(50), bytes(49) + b"\x01"]
        data = np.frombuffer(b"".join(segments) + bytes(8), np.uint8)
        ends = np.cumsum([len(s) for s in segments])
        at = [i for e, s in zip(ends.tolist(), segments) for i in range(e - len(s), e - 49)]
        windows = [data[i : i + 50].tobytes() for i in at]
        place = {w: k for k, w in enumerate(sorted(set(windows)))}
        assert suffix_dedup._windows(data, np.array(at)).tolist() == [place[w] for w in windows]


def test_equal_windows_choose_equal_places_in_blocks_of_any_length():
    import numpy as np

    r = np.random.default_rng(3)
    for span in (4, 1 << 60):
        h = r.integers(0, span, 3000).astype(np.uint64) << np.uint64(2)
        place = suffix_dedup._smallest(h)
        cut = suffix_dedup._smallest(h[1000:1100])
        assert (cut + 1000 == place[1000 : 1000 + len(cut)]).all()
        if span > 4:
            least = [i + int(np.argmin(h[i : i + suffix_dedup.SPAN])) for i in range(len(place))]
            assert place.tolist() == least


def test_workers_give_memory_back_after_a_group(monkeypatch):
    import pyarrow as pa

    from tabletrust.llm import text

    calls = []
    monkeypatch.setattr(text, "give_back", lambda: calls.append(1))
    rows = pa.table({"a": [1]})
    assert text.gives_back(lambda a: a)(rows) is rows
    assert text.gives_back(lambda a, b: b)(None, rows) is rows
    batch = pa.RecordBatch.from_pydict({"text": ["ab", None]})
    assert len(list(text.small_batches(iter([batch]), "text"))) == 1
    assert len(calls) == 3


# Decontamination

ITEMS = [
    (1, "Several documents share, word for word, one line of more than fifty bytes that is."),
    (10, "one line of more than fifty bytes that several documents share"),
    (2, "Second"), (2, "Second line"), (3, None), (4, " .,; "), (None, "marker"),
]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_leaks(spark, docs, nothing):
    named = [("" if i is None else i, t) for i, t in ITEMS]
    short = docs.where(F.length("text") < 10_000)
    rows = [(i, t) for i, t in pairs() if t is not None and len(t) < 10_000]
    same(decontaminate.report(short, items(spark)), brute.leaks(rows, named))
    assert decontaminate.report(docs, items(spark, [])).where("n_hit > 0").isEmpty()
    assert decontaminate.report(nothing, items(spark)).count() == 0


def test_benchmark_in_slices(spark, docs):
    whole = odd.plain(decontaminate.scan(docs, items(spark)))
    assert odd.plain(decontaminate.scan(docs, items(spark), slice_bytes=40)) == whole


def test_spans_are_cut(spark, docs):
    left = decontaminate.remove_spans(docs, items(spark))
    assert left.columns == docs.columns
    assert decontaminate.report(left, items(spark)).where("contaminated").isEmpty()
    clean = decontaminate.report(docs, items(spark)).where("not contaminated").count()
    assert left.count() >= clean
    assert left.where("n_chars <> length(coalesce(text, ''))").isEmpty()


def test_spans_behind_words_in_capitals(spark):
    item = " ".join(f"Item{k} of THE test," for k in range(6))
    before, behind = "SHOUTED words LIKE these! ÉTÉ " * 20, " and THIS comes behind it. OK" * 20
    docs = spark.createDataFrame([(1, before + item + behind)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    left = decontaminate.remove_spans(docs, bench).first().text
    assert left == before + "," + behind


def test_spans_of_all_slices_are_judged_and_cut_together(spark):
    first, second = (" ".join(f"{c}{k}" for k in range(24)) for c in "ab")
    crossing = " ".join([*first.split()[-6:], *second.split()[:6]])
    rest = " ".join(f"own{k}" for k in range(40))
    texts = [
        (1, f"{rest} {first} and {second}"),
        (2, f"{rest} {first} {second} {rest} {rest}"),
        (3, rest),
        (4, None),
    ]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame(
        [(1, first), (2, second), (3, crossing)], "item_id bigint, text string"
    )
    whole = odd.plain(decontaminate.remove_spans(docs, bench))
    assert whole == [(2, f"{rest}  {rest} {rest}"), (3, rest), (4, None)]
    for slice_bytes in (10, 60, 150):
        assert odd.plain(decontaminate.remove_spans(docs, bench, slice_bytes=slice_bytes)) == whole


# Line dedup


def test_lines_brute_force(spark):
    rows = mixed(5, 200)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = line_dedup.with_kept(frame).select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    same(got, brute.lines(rows))


def test_lines_odd_rows(docs, nothing):
    got = line_dedup.with_kept(docs, min_documents=2).select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)
    )
    same(got, brute.lines(pairs(), least=2))
    assert line_dedup.drop_lines(nothing).columns == nothing.columns


def test_hot_lines_take_the_other_way_to_the_same_result(spark, monkeypatch):
    rows = [(i, f"Hot LINE\nonly {i}\n" + "twice\n" * (i % 2)) for i in range(1_500)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 1e-3)
    assert line_dedup.hot_hashes(line_dedup.hashed_lines(frame), 1e-3).count() >= 1
    kept = line_dedup.with_kept(frame).select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    same(kept, brute.lines(rows))
    first = line_dedup.drop_lines(frame)
    assert first.where("text like '%Hot LINE%'").count() == 1
    assert first.where("text like '%twice%'").count() == 1


def test_many_lines_need_many_bitmap_words(spark):
    text = "\n".join(f"line {i}" for i in range(1_000))
    rows = [(i, text + f"\nown {i}") for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(
        line_dedup.with_kept(frame).select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)),
        brute.lines(rows),
    )


# N-gram join


def test_components_brute_force(spark):
    rows = mixed(9, 220)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    same(ngram_join.document_components(frame), brute.components(rows))


def test_components_over_many_chunks(spark, monkeypatch):
    rows = mixed(13, 120)
    monkeypatch.setattr(ngram_join.chunks, "CHUNK_BYTES", 3_000)
    monkeypatch.setattr(ngram_join.chunks.chunk_count, "__defaults__", (3_000,))
    monkeypatch.setattr(ngram_join.chunks.range_count, "__defaults__", (6_000,))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    same(ngram_join.document_components(frame), brute.components(rows))


def test_components_odd_rows(docs, nothing):
    same(ngram_join.document_components(docs), brute.components(pairs()))
    assert ngram_join.document_components(nothing).count() == 0
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns
    assert left.where("doc_id = 6").isEmpty() and left.where("doc_id = 5").count() == 1


def test_one_row_of_each_component_stays(spark):
    near = " ".join(f"w{k}" for k in range(60))
    far, alone, no_id = (" ".join(f"{c}{k}" for k in range(30)) for c in "xyz")
    rows = [
        (1, near, 1), (1, near, 1), (2, near + " again", 1), (None, near + " too", 1),
        (None, no_id, 1), (None, no_id + " too", 1), (None, no_id, 1),
        (2, far, 1), (9, far, 1), (2, alone, 1), (3, "", 1), (3, "", 1), (None, None, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, mark int").repartition(4)
    left = ngram_join.one_of_each(docs)
    assert left.schema == docs.schema
    left = odd.plain(left)
    of_no_id = [r for r in left if r[1] and r[1].startswith(no_id)]
    assert len(of_no_id) == 1 and of_no_id[0][0] is None
    expected = [(1, near, 1), (2, far, 1), (2, alone, 1), (3, "", 1), (3, "", 1), (None, None, 1)]
    assert sorted(set(left) - set(of_no_id), key=repr) == sorted(set(expected), key=repr)
    assert len(left) == len(expected) + 1


def test_trie_walk_is_exact():
    import numpy as np

    r = random.Random(2)
    some = lambda: np.array(sorted(r.sample(range(60), r.randint(1, 40)), reverse=True), np.uint64)
    for _ in range(40):
        pivot, others = some(), [some() for _ in range(30)]
        others += [np.delete(pivot, k) for k in range(min(5, len(pivot) - 1))]
        right = {
            i for i, o in enumerate(others)
            if 100 * len(set(pivot) & set(o)) >= 75 * len(set(pivot) | set(o))
        }
        sizes = [len(o) for o in others]
        assert set(ngram_join.trie_links(pivot, len(pivot), others, sizes)) == right


# Quality rules


def test_rules_brute_force(spark):
    rows = [(i, t, f"s{i % 2}") for i, t in mixed(21, 150)]
    rows += [(1_000 + i, "say it again and again my friend now " * 9, "s0") for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    same(line_rules.judge(frame, most_documents=5), brute.rules(rows, most=5))


def test_rules_of_one_text_under_two_hosts(spark):
    """The host with enough copies loses the line, the other keeps it, and nothing counts twice."""
    line = "a line of boilerplate that many pages of one host have, nothing more " * 2
    rows = [(i, line + f"\nown words of page {i} " + "and so on " * 8, "s0") for i in range(6)]
    rows += [(7, rows[0][1], "s0"), (7, rows[0][1], "s1"), (7, rows[0][1], None), (7, rows[0][1], None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for most in (1, 5, 6, 7):
        same(line_rules.judge(frame, most_documents=most), brute.rules(rows, most=most))


def test_rules_with_the_registered_limit_remove_lines(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(i, f"{text}\n{i} ends with a few words of its own", "s0") for i in range(11)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = line_rules.judge(frame).collect()
    assert all(r.n_removed > 30 and not r.base_failed and not r.kept for r in got)
    assert all(r.kept and not r.n_removed for r in line_rules.judge(frame.where("doc_id < 10")).collect())


def test_rules_odd_rows(docs, nothing):
    rows = [(r[0], r[1], r[3]) for r in odd.TEXTS]
    same(line_rules.judge(docs, most_documents=2), brute.rules(rows, most=2))
    assert line_rules.judge(nothing).count() == 0


# Pieces and counts


def test_pieces_odd_rows(docs, nothing):
    rows = pieces.encode(docs).collect()
    assert len(rows) == len(odd.TEXTS) and all(r.parity for r in rows)
    assert [r.n_ids for r in rows if r.doc_id in (2, 3)] == [0, 0]
    assert {r.doc_id for r in rows if not r.round_trip} == {7}
    back = pieces.decode(pieces.encode(docs.where("doc_id in (1, 5)")))
    same(back, [(i, t) for i, t in pairs() if i in (1, 5)])
    assert pieces.encode(nothing).count() == 0


def test_long_texts_encode_as_a_whole(monkeypatch):
    with open(pieces.MODEL_FILE, "rb") as f:
        model = pieces.parse_model(f.read())
    made = pieces.build(model)
    text = "  many  words \n in a   row, " * 50
    whole = made.encode(text, add_special_tokens=False).ids
    assert "".join(" " + p for p in pieces.parts_of(text, model, 40)) == " " + text
    monkeypatch.setattr(pieces, "PART_CHARS", 40)
    monkeypatch.setattr(pieces.parts_of, "__defaults__", (40,))
    assert pieces.encode_all([text], made, model)[0].tolist() == whole


def test_counts_odd_rows(docs, nothing):
    with open(pieces.MODEL_FILE, "rb") as f:
        model = pieces.parse_model(f.read())
    model.kind = pieces.UNIGRAM
    made = pieces.build(model)
    texts = [t or "" for _, t in pairs()]
    right = [(i, len(t), len(made.encode(t, add_special_tokens=False).ids)) for (i, _), t in zip(pairs(), texts)]
    same(token_counts.token_counts(docs), right)
    assert token_counts.token_counts(nothing).count() == 0


def test_count_ties_take_the_longest_last_piece():
    model = pieces.Model(
        [("<unk>", 0.0, 2), ("▁", -1.0, 1), ("a", -1.0, 1), ("b", -1.0, 1), ("ab", -2.0, 1)],
        pieces.UNIGRAM, False, b"", True, False, True,
    )
    counter = token_counts.Counter(model)
    made = pieces.build(model)
    for text in ("ab", "abab", "ba", "a cc b", "ccab c"):
        assert counter.count(text) == len(made.encode(text).ids), text


# Quality classifier


def test_scores_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (7, 1), (8, 1), (5, 0), (None, 1), (3, None)], "doc_id bigint, quality int"
    )
    model = line_crf.fit(docs, labels)
    got = line_crf.score(docs, model).select("doc.doc_id", "score").collect()
    assert len(got) == len(odd.TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert line_crf.good_documents(docs, model).columns == docs.columns
    assert line_crf.score(nothing, model).count() == 0
    untrained = line_crf.fit(nothing, labels)
    assert {r.score for r in line_crf.score(docs, untrained).collect()} == {0.5}


def test_marginals_equal_the_sum_over_all_labellings():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    counts = np.array([3, 1, 4])
    evidence, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    good, together = line_crf.chances(evidence, counts, moves)
    start = 0
    for n in counts:
        own = evidence[start : start + n]
        total, ones, both = 0.0, np.zeros(n), np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e for e, k in zip(own, y) if k) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total += w
            ones += w * np.array(y)
            both[:-1] += w * np.array([a and b for a, b in zip(y, y[1:])])
        assert np.allclose(good[start : start + n], ones / total)
        assert np.allclose(together[start : start + n, 1, 1], both / total)
        start += n


# URL trust


def test_rules_and_parts_of_urls(spark):
    rows = [
        ("HTTP://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("http://b.net/", "b.net", "/", "net/", "block"),
        ("x://y://z", "y:", "//z", None, "allow"),
        ("https://q.org/fr/?a", "q.org", "/fr/", "org/fr/", "allow"),
        ("https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("https://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/", "block"),
        (None, "", "", None, "allow"), ("nothing", "", "", None, "allow"), ("", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame(
        [(i, r[0], None, "x") for i, r in enumerate(rows)],
        "page_id bigint, url string, html string, host string",
    )
    got = {r.page_id: r for r in link_trust.verdicts(pages).collect()}
    for i, r in enumerate(rows):
        assert (got[i].host, got[i].path, got[i].rule) == r[1:4]
        if r[3]:
            assert got[i].verdict == r[4]
    assert link_trust.verdicts(pages.where("false")).count() == 0


def test_spread_equals_page_rank(spark):
    edges = {("a", "b"): 2.0, ("a", "c"): 1.0, ("b", "c"): 1.0, ("c", "a"): 3.0, ("d", "c"): 1.0}
    seeds = [("trust", "a", 0.75), ("trust", "d", 0.25), ("distrust", "c", 1.0)]
    got = link_trust.spread(
        spark.createDataFrame(seeds, "kind string, host string, seed double"),
        spark.createDataFrame([(*k, w) for k, w in edges.items()], "src string, dst string, weight double"),
    ).collect()
    good = brute.ranks({"a": 0.75, "d": 0.25}, edges, 0.85, 12)
    bad = brute.ranks({"c": 1.0}, {(b, a): w for (a, b), w in edges.items()}, 0.85, 12)
    for r in got:
        assert r.trust == pytest.approx(good.get(r.host, 0))
        assert r.distrust == pytest.approx(bad.get(r.host, 0))


def test_links_carry_distrust_back(spark):
    to = '<a href="http://bad.net/x">x</a>'
    rows = [(i, f"http://farm.test/{i}", to) for i in range(5)]
    rows += [(10, "http://bad.net/x", ""), (11, "http://calm.test/", "<a href='/own'>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in link_trust.verdicts(pages, least=0.1).collect()}
    assert got[0] == "block" and got[10] == "block" and got[11] == "allow"


# Tool calls

CALLS = "conv_id bigint, call_id string, turn bigint, tool string, arguments string, uses string"
RESULTS = "conv_id bigint, call_id string, turn bigint, content string"
TOOLS = [("add", "a", "integer", True), ("add", "b", "number", False), ("say", "x", "string", True)]


def test_calls_are_linked_ordered_and_checked(spark):
    calls = spark.createDataFrame(
        [
            (1, "p", 1, "add", '{ "b" : 1.50, "a": 2 }', None),
            (1, "q", 2, "add", '{"a":"2","z":true}', "p"),
            (1, "r", 3, "say", '{"x":"\\u00e9\\n"}', "q"),
            (1, "r", 4, "say", '{"x":"later"}', None),
            (2, "p", 1, "none", "{}", "gone"),
            (3, "m", 1, "say", "[1]", "n"),
            (3, "n", 2, "say", "not json", "m"),
            (3, "o", 3, "say", None, "m"),
            (None, "p", 1, "add", '{"a":1}', None),
            (4, None, 1, "add", '{"b":1}', None),
        ],
        CALLS,
    )
    results = spark.createDataFrame(
        [(1, "p", 9, "late"), (1, "p", 5, "early"), (2, "q", 2, "lost"), (3, "n", 3, None)], RESULTS
    )
    rows = tool_calls.formatted(calls, results, TOOLS).collect()
    got = {(r.conv_id, r.call_id): r for r in rows}
    assert len(rows) == 9
    p, q, r = got[1, "p"], got[1, "q"], got[1, "r"]
    assert (p.wave, p.n_results, p.faults) == (0, 2, "")
    assert p.message == '{"arguments":"{\\"a\\":2,\\"b\\":1.5}","id":"p","name":"add","result":"early"}'
    assert (q.wave, q.faults) == (1, "extra:z,type:a")
    assert (r.wave, r.copies, r.faults) == (2, 2, "")
    assert (got[2, "p"].order_state, got[2, "p"].faults) == ("missing", "unknown_tool")
    assert {got[3, k].order_state for k in "mno"} == {"cyclic"}
    assert {got[3, k].faults for k in "mno"} == {"malformed"}
    assert got[None, "p"].order_state == "loose" and got[4, None].faults == "missing:a"
    orphans = tool_calls.orphan_results(calls, results).collect()
    assert [(x.conv_id, x.n) for x in orphans] == [(2, 1)]


def test_a_long_chain_takes_few_rounds(spark):
    n = 300
    calls = spark.range(n).selectExpr(
        "1L as conv_id", "cast(id as string) as call_id", "id as turn", "'say' as tool",
        "'{\"x\":\"\"}' as arguments", "if(id = 0, null, cast(id - 1 as string)) as uses",
    )
    order = tool_calls.waves(tool_calls.linked(calls, spark.createDataFrame([], RESULTS)))
    assert order.where("wave <> cast(call_id as bigint) or order_state <> 'ordered'").isEmpty()
    assert order.count() == n


def test_odd_turns(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", None, "x"), (1, 1, "assistant", None, "x"), (None, 0, "user", "a", "x"),
         (2, None, "user", "b", "x"), (3, 0, None, "c", "x"), (1, 0, "user", None, "x")],
        "conv_id bigint, turn bigint, role string, text string, call_id string",
    )
    calls, results = tool_calls.calls_of_turns(turns)
    rows = tool_calls.formatted(calls, results, tool_calls.CHAT_TOOLS).collect()
    assert {r.conv_id for r in rows} == {1, 2, None}
    empty = tool_calls.calls_of_turns(turns.where("false"))
    assert tool_calls.formatted(*empty, tool_calls.CHAT_TOOLS).count() == 0


def test_quality_sample_follows_the_hash_and_not_the_length(spark, monkeypatch):
    """Short and long documents are in the fit alike; labels without a document use up no places."""
    rows = [(i, "\n".join([f"line {k} of {i}" for k in range(2 if i % 2 else 40)])) for i in range(900)]
    rows.append((5_000, "x\n" * 2_000))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 4 // 2) for i in range(8_000)], "doc_id bigint, quality int")
    used = {}
    fit = line_crf.fit_arrays
    monkeypatch.setattr(line_crf, "fit_arrays", lambda x, s, counts, m: used.update(n=counts) or fit(x, s, counts, m))
    line_crf.fit(docs, labels, most_docs=500, most_lines=4_000)
    long = (used["n"] >= 40).mean()
    assert 0.35 < long < 0.65 and used["n"].max() < 200 and 3_900 < used["n"].sum() <= 4_000
    line_crf.fit(docs, labels, most_docs=500)
    assert len(used["n"]) == 500
