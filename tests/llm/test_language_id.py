import random
import zlib

import pytest

from nimbostrat.llm.language_id import UNKNOWN, fit, identify, kneser_ney, languages, words_of

STEMS = {"aa": ["lor", "ven", "tik", "sarn", "oel"], "bb": ["mu", "zhai", "qong", "xi", "bao"], "cc": ["ñera", "ción", "osta", "lle", "dré"]}


def corpus(n=240):
    rng = random.Random(4)
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(STEMS))
        words = ["".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 40))]
        rows.append((k, " ".join(words).capitalize() + ".", lang, "s"))
    return rows


def test_held_out_accuracy_and_scores(docs, by_id):
    rows = corpus()
    out = by_id(languages(docs(rows)))
    held = [r for r in rows if out[r[0]]["held_out"]]
    assert held and all(out[k]["lang_pred"] == lang for k, _, lang, _ in held)
    assert all(0 <= v["score"] <= 1 and not v["rejected"] for v in out.values())


def test_odd_texts(docs, by_id):
    rows = corpus() + [(1000, None), (1001, "123 !!"), (1002, ""), (1003, "漢字仮名交文 " * 30), (1004, "Lorven 42"), (1005, "text", None, None)]
    out = by_id(languages(docs(rows)))
    assert all(out[k]["lang_pred"] == UNKNOWN and out[k]["score"] == 0 for k in (1000, 1001, 1002))
    assert out[1003]["rejected"] and out[1003]["lang_pred"] in STEMS
    assert out[1004]["lang_pred"] == "aa" and not out[1004]["rejected"]


def test_labels_of_held_out_rows_are_never_used(docs, by_id):
    rows = corpus()
    out = by_id(languages(docs(rows)))
    swapped = [(k, t, "zz" if out[k]["held_out"] else lang, s) for k, t, lang, s in rows]
    assert {k: v["lang_pred"] for k, v in by_id(languages(docs(swapped))).items()} == {k: v["lang_pred"] for k, v in out.items()}


def test_odd_tables(docs, by_id):
    assert languages(docs([])).count() == 0
    alone = by_id(languages(docs([(1, "words without labels")])))
    assert alone[1]["lang_pred"] == UNKNOWN
    clash = docs(corpus(40)).withColumnRenamed("source", "score")
    assert identify(clash).columns.count("score") == 1
    assert len(languages(docs(corpus(40) * 2)).collect()) == 80


def test_probabilities_sum_to_one_over_seen_characters():
    counts = {}
    for word in ["abc", "abd", "bcd", "aab"]:
        padded = "    " + word + " "
        for k in range(len(word) + 1):
            counts[padded[k : k + 5]] = counts.get(padded[k : k + 5], 0) + 1
    probabilities, weights = kneser_ney(counts)
    assert sum(2 ** p for p in probabilities[0].values()) == pytest.approx(1 - 2 ** weights[0][""], abs=1e-3)
    assert all(p <= 1e-9 for level in probabilities for p in level.values())


def test_words_and_bounds(docs):
    assert words_of("It's 3 ²") == ["it", "s", "²"] and words_of("² 3") == []
    whole, small = fit(docs(corpus())), fit(docs(corpus()), train_chars=300)
    assert whole.languages == sorted(STEMS) and set(small.languages) <= set(STEMS)
    assert 0 < len(small.grams[-1][0]) < len(whole.grams[-1][0])


def plain_entropy(words, probabilities, weights):
    """Bits a character by looking up every n-gram as a string, longest first."""
    bits = n = 0
    for word in words:
        padded = "    " + word + " "
        for end in range(5, len(padded) + 1):
            weight = 0.0
            for k in range(5, 0, -1):
                gram = padded[end - k : end]
                if gram in probabilities[k - 1]:
                    weight += probabilities[k - 1][gram]
                    break
                weight += weights[k - 1].get(gram[:-1], 0.0)
            else:
                weight += -20.0
            bits, n = bits - weight, n + 1
    return bits / n


def test_predictions_match_plain_models(docs, by_id):
    rows = corpus(120) + [(2000, "Ünlike any of them, lorven", None, None), (2001, "xi " * 60_000, None, None)]
    fitted = {}
    for k, text, lang, _ in rows:
        if lang and zlib.crc32(str(k).encode()) % 5 > 1:
            counts = fitted.setdefault(lang, {})
            for word in words_of(text):
                padded = "    " + word + " "
                for i in range(len(word) + 1):
                    counts[padded[i : i + 5]] = counts.get(padded[i : i + 5], 0) + 1
    models = {lang: kneser_ney(counts) for lang, counts in fitted.items()}
    out = by_id(languages(docs(rows)))
    for k, text, _, _ in rows:
        entropies = {lang: plain_entropy(words_of(text)[:2000], *m) for lang, m in models.items()}
        best = min(sorted(entropies), key=entropies.get)
        assert out[k]["lang_pred"] == best and out[k]["cross_entropy"] == pytest.approx(entropies[best])
        assert out[k]["score"] == pytest.approx(1 / sum(2 ** (entropies[best] - e) for e in entropies.values()))


#: Made of the same letters; "cc" shares three stems with "aa".
NEAR = {"aa": ["lor", "ven", "tik", "sarn", "oel"], "bb": ["rol", "nev", "kit", "nars", "leo"], "cc": ["lor", "ven", "tik", "arsn", "elo"]}


def near_corpus(rng, lang, n, first):
    return [(first + k, " ".join("".join(rng.choices(NEAR[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 60))), lang, "s") for k in range(n)]


def test_unlearned_language_of_the_same_letters_is_rejected(docs, by_id):
    rng = random.Random(9)
    learned = near_corpus(rng, "aa", 300, 0) + near_corpus(rng, "bb", 300, 1000)
    other = [(k, t, None, s) for k, t, _, s in near_corpus(rng, "cc", 60, 2000)]
    # one odd text in the calibration fold doesn't widen the limit
    odd = [(k, "xqzw jjvk " * 40, lang, "s") for lang in ("aa", "bb") for k in range(3000 + 100 * (lang == "bb"), 3020 + 100 * (lang == "bb")) if zlib.crc32(str(k).encode()) % 5 == 1][::4]
    assert odd
    out = by_id(languages(docs(learned + other + odd)))
    assert all(out[k]["rejected"] for k, *_ in other)
    assert all(not out[k]["rejected"] and out[k]["lang_pred"] == lang for k, _, lang, _ in learned)


def test_calibration_fold_is_kept_out_of_fitting(docs, by_id):
    rows = corpus()
    shown = by_id(languages(docs(rows)))
    hidden = [(k, t, None if zlib.crc32(str(k).encode()) % 5 == 1 else lang, s) for k, t, lang, s in rows]
    assert {k: v["cross_entropy"] for k, v in by_id(languages(docs(hidden))).items()} == pytest.approx({k: v["cross_entropy"] for k, v in shown.items()})
