import hashlib
import random

import pyarrow as pa

from stratagraph.llm import substring, textcols


def expected(texts, size=50):
    held = [(i, (t or "").encode().split()) for i, t in texts]
    first = {}
    for i, w in held:
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            if i is not None and (g not in first or i < first[g]):
                first[g] = i
    out = []
    for i, w in held:
        drop = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                drop.update(range(k, k + size))
        left = b" ".join(x for k, x in enumerate(w) if k not in drop)
        out.append((i, len(w), len(drop), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def run(df, **kw):
    return sorted((tuple(r) for r in substring.substring_dedup(df, **kw).drop("kept_text").collect()), key=repr)


def test_edges(make, edges):
    assert run(make(edges)) == expected(edges)
    assert run(make([])) == []


def test_whole_table_against_all_windows(documents, texts):
    assert run(documents) == expected(texts)


def test_shared_passages_runs_and_twins(make):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    passages = [" ".join(word(1 + k % 3) for _ in range(60 + 9 * k)) for k in range(5)]
    some = []
    for i in range(60):
        parts = [" ".join(word(2) for _ in range(rng.randrange(70))) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(passages))
        parts.insert(rng.randrange(3), "same " * rng.randrange(120))
        some.append((i % 50, " ".join(parts)))
    assert run(make(some)) == expected(some)
    assert run(make(some), bits=3) == expected(some)  # windows of other words share names


def test_small_windows(make):
    rng = random.Random(4)
    some = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(60)))) for i in range(40)]
    assert run(make(some), size=6) == expected(some, 6)
    assert run(make(some), size=6, bits=5) == expected(some, 6)


def test_names_roll_over_the_words_of_a_window():
    words = textcols.Words(pa.array(["a b c a b c a", "", "x b c a"]))
    names = substring._window_names(words, substring.windows(words, 3), 3, 64).tolist()
    assert names[0] == names[3] and names[1] == names[4] == names[6] and names[2] not in (names[0], names[1]) and len(set(names)) == 4


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_under_plain_polynomials_stay(make):
    """Such words have one polynomial hash modulo a power of two, whatever its base."""
    one, two = thue_morse(4096)
    words = [f"w{k}" for k in range(60)]
    some = [(1, " ".join([*words, one, *words[:5]])), (2, " ".join([*words[20:], two, *words[:30]])), (3, " ".join([*words[20:], one, *words[:30]]))]
    assert run(make(some)) == expected(some)


def test_many_rows_of_one_id_and_a_very_long_word(make):
    long = "x" * 300_000
    words = " ".join(f"w{k}" for k in range(70))
    some = [(5, f"{words} {k}") for k in range(20)] + [(7, f"{long} {words} {long}"), (8, f"{words} {long} {words}"), (None, words), (5, f"{words} 3")]
    assert run(make(some)) == expected(some)


def test_rows_of_one_id_meet_only_themselves(spark, make):
    """As many rows come out of the join with the marks as go in, not their square."""
    words = " ".join(f"w{k}" for k in range(70))
    some = [(5, f"{words} {k}") for k in range(400)] + [(9, words)]
    out = substring.substring_dedup(make(some))
    assert out.count() == 401 and out.filter("n_removed > 0").count() == 1
    assert sorted((tuple(r) for r in out.drop("kept_text").collect()), key=repr) == expected(some)
