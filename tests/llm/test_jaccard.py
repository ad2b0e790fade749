import random

from stratagraph.llm import jaccard


def grams(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + n]) for k in range(max(len(words) - n + 1, 1 if words else 0))}


def expected(texts, threshold=0.8):
    sets = [grams(t) for _, t in texts]
    n = len(texts)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i].append(j), links[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j), todo.append(j)
        low = min((texts[j][0] for j in seen if texts[j][0] is not None), default=None)
        out.append((texts[i][0], len(links[i]), low, texts[i][0] == low))
    return sorted(out, key=repr)


def run(df):
    return sorted((tuple(r) for r in jaccard.similar_documents(df).select("doc_id", "n_links", "group_id", "kept").collect()), key=repr)


def test_edges(make, edges):
    assert run(make(edges)) == expected(edges)


def test_a_repeated_smallest_id_counts_once_in_its_blocks(make):
    words = [f"w{k}" for k in range(100)]
    near = " ".join([*words[:-1], "other"])
    some = [(9, " ".join(words)), (9, " ".join(words)), (10, near)]
    assert [r[1] for r in run(make(some))] == [2, 2, 2]
    some += [(9, near), (11, " ".join(words).upper()), (None, near)]
    assert run(make(some)) == expected(some)


def test_empty(make):
    assert run(make([])) == []


def test_whole_table_against_all_pairs(documents, texts):
    assert run(documents) == expected(texts)


def test_a_large_group_is_cut_into_blocks_without_losing_links(make):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    some = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        some.append((i, " ".join(words[: 120 - rng.randrange(4)])))
    assert run(make(some)) == expected(some)


def test_prefixes_shorten_until_the_recall_is_met():
    every = [1000] * (jaccard.DEPTH + 1)
    k = jaccard.prefix_length([0] * len(every), 0, 0.8)
    assert jaccard.expected_recall(k, 0.8) >= jaccard.RECALL > jaccard.expected_recall(k + 1, 0.8)
    assert jaccard.prefix_length([0] * len(every), 0, 0.5) < jaccard.prefix_length([0] * len(every), 0, 0.95)
    assert jaccard.prefix_length(every, 10**9, 0.8) == 1  # all but few were lost
    assert jaccard.prefix_length([10**9] * len(every), 10**9, 0.8) == jaccard.DEPTH


def test_shingles_are_told_apart_by_their_words():
    rng = random.Random(3)
    some = ["", " ", "a", "a b", " A  b ", "a b c d e", "a b c d e f", "\ta\x0bb c d e f\n", "É b c d e", "é b c d e"]
    some += [" ".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(60)]
    got, want = jaccard.word_shingles(some, 5), [grams(t) for t in some]
    for a in range(len(some)):
        assert len(got[a]) == len(want[a])
        for b in range(a):
            assert len(set(got[a]) & set(got[b])) == len(want[a] & want[b])


def test_classes_that_collide_are_told_apart(make, edges):
    words = [f"w{k}" for k in range(30)]
    some = [(1, " ".join(words)), (2, " ".join(words[:20])), (3, " ".join(words).upper()), (4, "same " * 9), (5, "same " * 14), (6, None), (None, "same " * 20), (7, " ".join(words[1:]))]
    out = jaccard.similar_documents(make(some + edges), class_bytes=0).select("doc_id", "n_links", "group_id", "kept")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == expected(some + edges)


def test_a_chain_of_documents_is_compared_node_by_node(make):
    """Each shares two thirds of its shingles with the next: one cluster, few links."""
    rng = random.Random(8)
    stream = [f"w{k}" for k in range(6000)]
    some = [(i, " ".join(stream[i * 12 : i * 12 + 64])) for i in range(480)]
    some += [(1000 + i, " ".join([*stream[i * 12 : i * 12 + 62], f"x{rng.randrange(9)}"])) for i in range(0, 480, 7)]
    assert run(make(some)) == expected(some)


def test_another_threshold_loses_no_link_between_bands_of_sizes(make):
    words = [f"w{k}" for k in range(330)]
    some = [(i, " ".join(words[: 20 + i])) for i in range(300)]
    out = jaccard.similar_documents(make(some), threshold=0.5).select("doc_id", "n_links", "group_id", "kept").collect()
    assert sorted((tuple(r) for r in out), key=repr) == expected(some, 0.5)
