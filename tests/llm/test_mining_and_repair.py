"""Hard negatives, fingerprint trees and chat repair against brute force."""

import itertools
import random

import brute
import odd
import pytest

from tabletrust.llm import chat_repair, hard_negatives, simhash_trees
from tabletrust.llm.text import table

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<double>, label int, score double, key string, mark int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "k", 2) for r in rows], VECTORS)


def test_negatives_of_awkward_rows(spark):
    rnd = random.Random(3)
    nan, far = float("nan"), float("inf")
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)], rnd.randrange(3)) for i in range(400)]
    rows += [(None, [1.0, 0.5, 0.5, 0.5], 1), (None, [1.0, 0.5, 0.5, 0.5], 2)]
    rows += [(5, None, 1), (6, [1.0, 2.0, 3.0, 4.0], None), (8, [1.0, None, 0.0, 0.0], 1)]
    rows += [(9, [nan, 0.0, 0.0, 0.0], 1), (10, [far, 0.0, 0.0, 0.0], 1), (11, [1.0], 1), (12, [], 1)]
    # One vector under many ids and labels, repeated rows, repeated and odd anchors, huge components.
    rows += [(i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(1000, 1300)]
    rows += [(700, [0.5, 0.5, 0.5, 0.5], 1)] * 3 + [(800, [1.0, 0.0, 0.0, 0.0], 2)] * 2
    rows += [(800, [0.0, 1.0, 0.0, 0.0], 0), (-100, [0.1, 0.2, 0.3, 0.4], 0), (900, [], 1), (900, [2.0], 4)]
    rows += [(1500, [1e300, 1.0, 0.0, -1e18], 1), (1501, [1e18, 1.0, 0.0, 1.0], 1), (1502, [3e17, 1.0, 0.0, 1.0], 0)]
    want = sorted(brute.negatives(rows), key=repr)
    for slice_bytes in (32 << 20, 100):
        got = hard_negatives.mine(vectors(spark, rows), slice_bytes)
        assert odd.plain(got) == want


def test_negatives_where_labels_or_anchors_lack(spark):
    rows = [(100, [1.0, 0.0], 1), (200, [0.0, 0.0], 1), (201, [-1.0, 0.0], 1), (202, [0.0, 1.0], 2)]
    assert odd.plain(hard_negatives.mine(vectors(spark, rows))) == sorted(brute.negatives(rows), key=repr)
    assert odd.plain(hard_negatives.mine(vectors(spark, rows[2:]))) == []
    assert odd.plain(hard_negatives.mine(vectors(spark, []))) == []


def test_reader_holds_open_windows_only():
    pack = lambda score, kind, i: (hard_negatives._KEY.pack(
        1 << 63, 0, hard_negatives.MOST_SCORE - score, kind, 0, i + (1 << 63)), None)
    pairs = [pack(10, 0, 1), pack(10, 1, 2), pack(9, 0, 3)]
    pairs += (pack(8, 1, i) for i in range(10, 20))
    pairs += [pack(7, 1, 30), pack(7, 0, 31)]
    out = list(hard_negatives.emit(iter(sorted(pairs))))
    assert [r[1:4] for r in out] == [
        (1, 1, 2), *itertools.chain(*(((1, k + 2, 10 + k), (3, k + 1, 10 + k)) for k in range(4))),
        (3, 5, 14), (31, 1, 30),
    ]


def test_fingerprints_follow_the_definition(spark):
    rows = [(r[0], r[1]) for r in odd.TEXTS]
    got = odd.plain(simhash_trees.fingerprints(odd.documents(spark)))
    assert [(i, p & (1 << 64) - 1) for i, p in got] == sorted(
        ((i, brute.simhash(t)) for i, t in rows), key=lambda r: repr((r[0], r[1] - (r[1] >> 63 << 64)))
    )


def test_fingerprint_components_of_awkward_texts(spark):
    rows = [(r[0], r[1]) for r in odd.TEXTS]
    got = odd.plain(simhash_trees.document_components(odd.documents(spark)))
    assert got == sorted(brute.simhash_components(rows), key=repr)
    assert odd.plain(simhash_trees.document_components(odd.documents(spark, []))) == []


def test_fingerprint_components_of_a_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = sorted(brute.simhash_components(rows), key=repr)
    assert odd.plain(simhash_trees.document_components(docs)) == want


@pytest.mark.parametrize("most_nodes", [8, 64, 1024])
def test_links_of_crowded_fingerprints(spark, most_nodes):
    """Most prints agree in most bits, so that buckets are cut again and again."""
    rnd = random.Random(most_nodes)
    prints = {rnd.getrandbits(64) & 0xFF000000000FFF0F for _ in range(700)}
    prints |= {p ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for p in list(prints)[:200]}
    signed = [(simhash_trees._signed(p),) for p in prints]
    classes = spark.createDataFrame(signed, "print bigint")
    links = simhash_trees.print_links(classes, most_nodes=most_nodes)
    label = {p: p for (p,) in signed}

    def find(p):
        while label[p] != p:
            p = label[p]
        return p

    n_links = 0
    for a, b in links.collect():
        assert ((a ^ b) & (1 << 64) - 1) or a == b
        label[find(a)] = find(b)
        n_links += 1
    for (a,), (b,) in itertools.combinations(signed, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
            assert find(a) == find(b)
    # Links follow the rows and the parts, not the pairs.
    assert n_links <= 4 * len(prints) * 16


def test_trees_link_the_first_of_a_component():
    prints = [0, 0b111, 0b111111, 15 << 40, (15 << 40) | 1, 31 << 20]
    assert simhash_trees.within(prints) == [(1, 0), (2, 0), (4, 3)]
    assert simhash_trees.within([]) == [] and simhash_trees.within([5]) == []


CHATS = "conv_id bigint, turn bigint, role string, text string, pos bigint, code string, moves int"
REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CHATS)


def repaired(spark, rows):
    return odd.plain(chat_repair.report(chats(spark, rows)).select(REPORT))


def test_repair_of_awkward_turns(spark):
    rnd = random.Random(5)
    texts = ["Yes.", "No", "", " \t\n", "Well!", None, "Ünd?\r\n", "a.\x00", "long. " * 5_000]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "sam"]
    rows = [
        (rnd.choice([None, *range(60)]), rnd.choice([None, *range(9)]), rnd.choice(roles), rnd.choice(texts))
        for _ in range(600)
    ]
    assert repaired(spark, rows) == sorted(brute.chats(rows), key=repr)
    assert repaired(spark, []) == []


def test_repair_of_a_long_chat(spark, monkeypatch):
    """A third of all turns are one chat, whose codes travel in many runs over several partitions."""
    monkeypatch.setattr(chat_repair, "PACKED_BITS", 5)
    rnd = random.Random(6)
    turn = lambda k: (rnd.choice(["user", "assistant"]), rnd.choice([f"t{k}.", f"t{k}", "same."]))
    rows = [(1, k, *turn(k)) for k in range(3_000)]
    rows += [(2 + k // 6, k % 6, *turn(k)) for k in range(6_000)]
    assert repaired(spark, rows) == sorted(brute.chats(rows), key=repr)


def test_auction_settles_shortest_paths():
    rnd = random.Random(7)
    for _ in range(200):
        n = rnd.randrange(1, 40)
        arcs = [
            [("x", rnd.randrange(1, 9), rnd.randrange(n + 2)) for _ in range(3)] + [("y", 30, n + i % 2)]
            for i in range(n)
        ]
        ends = [rnd.randrange(5), rnd.randrange(5)]
        price = [min(ends)] * n + ends
        chat_repair.auction(arcs, price, range(n))
        exact = [10**6] * n + ends
        for _ in range(n + 1):
            for i in range(n):
                exact[i] = min(exact[i], *(c + exact[j] for _, c, j in arcs[i]))
        assert price == exact


def test_pieces_do_not_change_the_repair(monkeypatch):
    rnd = random.Random(8)
    codes = ["".join(rnd.choice(chat_repair.CODES) for _ in range(rnd.randrange(60))) for _ in range(50)]
    whole = [(c, "".join(m)) for c, m in map(chat_repair.repair, codes)]
    for size in (1, 3, 100):
        monkeypatch.setattr(chat_repair, "PIECE", size)
        assert [(c, "".join(m)) for c, m in map(chat_repair.repair, codes)] == whole


def test_repaired_turns_are_well_formed(spark):
    rows = chat_repair.in_order(chat_repair.damaged(table(spark, FOLDER, "conversations")))
    edits = chat_repair.solved(chat_repair.packed(chat_repair.judged(rows)))
    turns = chat_repair.repaired_turns(rows, edits).orderBy("conv_id", "pos", "place").collect()
    for _, own in itertools.groupby(turns, lambda r: r.conv_id):
        roles = [r.role for r in own]
        roles = roles[1:] if roles[0] == "system" else roles
        assert roles == ["user", "assistant"] * (len(roles) // 2) and roles
