import numpy as np
import pytest

from axiomill.llm.quality import FUNCTION_WORDS, LANGUAGES, PROFILES, COMMON, divergences, fit, languages, runs, start, statistics, text_quality, token_counts

PROSE = "When a rule repeats its premise, the broad clause below it must be checked too. We often found that the relation is empty, but the file did not change. "
WORDS = "rule clause premise relation file index parser term broad empty".split()


def prose(n):
    """So many different sentences."""
    return "".join(f"When the {a} is not {b}, we often found that it was {i}. " for i, (a, b) in enumerate([(a, b) for a in WORDS for b in WORDS][:n]))


TEXTS = {
    "prose": [
        prose(9), PROSE.replace(", ", ",\n").replace(". ", ".\n"), "i think it is fine but the index is not\nok so what does the parser do when it is empty\nthanks, that was it, the file was just old :)",
        "Wir haben die Regel geprüft, weil sie nicht gilt. Nach dem Laden war die Datei noch leer, aber sie ist es nicht.", "> La regla es abierta, pero no vale para la clase.\n> Hay que ver la lista, ya que no es una de ellas.",
        PROSE.upper(), PROSE.lower().replace(",", "").replace(".", ""),
    ],
    "code": ["(=> (and (instance ?X Foo) (part ?X ?Y))\n    (exists (?Z) (near ?Y ?Z)))\n(subclass Foo Bar)\n" * 4, "fof(kb_1,axiom,( s__p(s__A,s__B) )).\n" * 5],
    "list": ["* rule\n* narrow term\n* Clause\n* relation / file\n" * 4, "1. rule\n2. term\n3. BroadValve\n4. file\n" * 5, "rule ........ 12\nterm ............ 14\nfile ..... 20\n" * 4],
    "table": ["| rule | term |\n|---|---|\n| 12 | yes |\n| 14.5 | no |\n" * 4, "rule\tterm\tfile\n12\t3.5\tyes\n14\t2.5\tno\n" * 4, "a,b,c\n1,2.5,yes\n2,3.5,no\n" * 5],
    "junk": ["rule term rule file term rule rule term file term " * 10, "Home | Next > | Index\n" * 20, "hA8sKd92LLq0ZmXxPq71TtR/+8sQwErTy" * 10, "+=<>|~^ %$#@ =+~^|<>\n" * 8, "[11:27:50.259] 0xd45a46a9 TRC p=561589 q=0.8540\n" * 6],
}


@pytest.mark.parametrize("kind", TEXTS)
def test_kinds(kind):
    for text, got in zip(TEXTS[kind], statistics(TEXTS[kind])):
        assert (got["prose_share"] >= 0.5) == (kind == "prose"), (text[:60], got)


def test_mixed_texts_count_characters():
    table = TEXTS["table"][0]
    mostly, hardly = statistics([prose(40) + "\n\n" + table[:60], PROSE[:70] + "\n\n" + table * 9])
    assert mostly["prose_share"] > 0.8 and hardly["prose_share"] < 0.3


def test_repeated_sentences_are_no_prose():
    assert statistics(["We found that it is not there. " * 30])[0]["prose_share"] == 0


def test_divergence_is_a_metric_of_profiles():
    """A long run drawn from a profile is nearest to it, and no two are farther apart than one bit."""
    m = start()
    counts = np.round(m.shares * 100_000)
    for k in range(len(LANGUAGES)):
        words = [{i: round(share * n) for i, share in enumerate(m.words[k]) if round(share * n)} for n in counts[:, 0]]
        d = divergences(counts, words, m, np.full(len(counts), k))
        prose = np.array([kind == "prose" for kind, _ in PROFILES])
        assert np.allclose(np.diag(d)[prose], 0, atol=1e-2) and (d >= -1e-9).all() and (d <= 1 + 1e-9).all()
        assert (d.argmin(axis=1) == np.arange(len(d)))[prose].all()


def test_divergence_by_its_definition():
    """Against the plain sum over all words and classes."""
    m = start()
    text = "The rule of the file is not in it, but 12 of them were Broad (x)."
    n, words, *_ = token_counts(text)
    got = divergences(np.array([n], float), [words], m, np.array([0]))[0]
    size = sum(n)
    for s, (kind, _) in enumerate(PROFILES):
        v = m.words[0] if kind == "prose" else m.words.mean(axis=0)
        q = np.concatenate([m.shares[s][0] * v, m.shares[s][1:]])
        c = np.zeros(len(q))
        for i, k in words.items():
            c[i] = k
        c[len(v) :] = n[1:]
        p = (c + 20 * q) / (size + 20)
        mid = (p + q) / 2
        want = sum(x * np.log2(x / y) for a in (p, q) for x, y in zip(a, mid) if x > 0) / 2
        assert abs(got[s] - want) < 1e-9


def test_each_language_has_its_own_words():
    texts = {"en": "When the rule is not broad we found that it was there.", "de": "Wenn die Regel nicht gilt, haben wir sie auch noch mit der Datei.", "fr": "Quand la règle est vide, nous avons dans le fichier une autre.", "es": "La regla es abierta, pero no vale para la clase y hay una más."}
    got = languages([token_counts(t)[1] for t in texts.values()], start())
    assert [LANGUAGES[k] for k in got] == list(texts) == list(FUNCTION_WORDS)
    assert [r["language"] for r in statistics([t + " " + t.replace("a", "o") for t in texts.values()])] == list(texts)


def test_fit_moves_profiles_towards_the_labelled_texts(spark):
    docs = [(i, prose(20 + i)) for i in range(30)] + [(100 + i, "~~ rule ~~ FooBar12 ~~ term\n" * 9) for i in range(30)] + [(500, None), (501, " ")]
    labels = [(i, "prose") for i in range(30)] + [(100 + i, " List") for i in range(30)] + [(0, "junk"), (500, "prose"), (501, "list"), (None, "list"), (3, None), (7, "prose"), (900, "code"), (5, "poem")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    y = spark.createDataFrame(labels, "doc_id bigint, kind string")
    m, first = fit(d, "doc_id", "text", y, "doc_id", "kind"), start()
    assert np.allclose(m.shares.sum(axis=1), 1) and np.allclose(m.words.sum(axis=1), 1)
    assert m.words[0][COMMON["when"]] > 2 * first.words[0][COMMON["when"]] and np.allclose(m.words[1], first.words[1])
    again = fit(d, "doc_id", "text", y, "doc_id", "kind")
    assert (again.shares == m.shares).all() and (again.words == m.words).all()
    none = fit(d, "doc_id", "text", y.limit(0), "doc_id", "kind")
    assert np.allclose(none.shares, first.shares)


def test_counts():
    n, common, words, letters, size = token_counts("The Foo-12 is, ok (x).")
    assert words == 6 and letters == 13 and size == 18
    assert n[0] == 2 == sum(common.values()) and n[4] == 1 and n[6] == 2 and n[5] == 2
    assert [r for r, _ in runs("a b\n\n\nc\r\n(instance X Y)\n  (z)\n")] == ["a b", "c", "(instance X Y)\n  (z)"]


def test_frame(spark):
    long = PROSE * 20_000
    rows = [(1, PROSE * 2, 0), (2, None, 0), (3, " \n\t", 0), (4, "x", 0), (5, long, 0), (None, PROSE, 0), (1, "+++", 0), (6, "日本語のテキストです。", 0)]
    got = text_quality(spark.createDataFrame(rows, "doc_id bigint, text string, kind int"), "doc_id", "text").collect()
    assert sorted(r["doc"] for r in got) == [1, 1, 4, 5, 6]
    assert next(r for r in got if r["doc"] == 5)["n_words"] == 20_000 * len(PROSE.split())
    assert text_quality(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0
