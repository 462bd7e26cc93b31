import itertools

from chainloom.llm import stuffing
from tests.llm.test_llm import OTHER, PROSE, shares

WORDS = ["".join(p) for p in itertools.product(("bra", "keld", "mun", "tor", "vis"), ("an", "ex", "il", "ock"), ("dar", "fen", "gor"))]


def share(text):
    return shares(text)[1][0][stuffing.USUAL]


def test_lists_of_different_words_are_found():
    assert len(set(WORDS)) == 60
    for separator in (", ", " | ", "; "):
        assert share("tags: " + separator.join(WORDS)) > 0.5
        assert share("tags: " + separator.join(f"{a} {b}" for a, b in zip(WORDS[::2], WORDS[1::2]))) > 0.5
    assert share("\n".join(f"{i},{i * 7},{i * 0.25},{w}" for i, w in enumerate(WORDS))) < 0.5
    assert share(" ".join(WORDS)) < 0.5


def test_a_record_mark_exempts_only_what_is_around_it():
    links = " ".join(f"https://shop.name{i}.example/low-fees?ref={i}" for i in range(60))
    words = "cheap wallet airdrop promo code " * 60
    for mark in ("ab12cd34" * 8, "https://explorer.example/tx/" + "ab12cd34" * 8, "<style>p {color: red}</style>", "12:00:43 height=7"):
        for page in (links, words):
            assert share(f"{page} {mark} {page}") > 0.5, mark
            assert share(f"{mark} {page} {mark}") > 0.5, mark
    for name in ("log", "records", "hashes", "code"):
        assert share(OTHER[name].replace("\n", " ")) < 0.5, name
        assert share(OTHER[name]) < 0.5, name


SPARSE = ", ".join(x for i in range(0, 56, 7) for x in [*WORDS[i : i + 7], sorted(stuffing.FUNCTION_WORDS["en"])[i]])


def test_evidence_is_taken_under_each_bound():
    got = shares(SPARSE)[1][0]
    assert got[stuffing.USUAL - 1] == 0 and got[stuffing.USUAL + 2] > 0.5


def test_one_rule_at_every_size(spark):
    bounds = []
    for copies in (9, 210):
        rows = [(i, SPARSE, "en") for i in range(copies)]
        found = stuffing.stuffing(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
        bounds.append({(r.lang, r.bound) for r in found.select("lang", "bound").distinct().collect()})
    assert bounds[0] == bounds[1] and {b for _, b in bounds[0]} != {stuffing.BOUNDS[stuffing.USUAL]}


FURTHER = {
    "ru": "Если узел не знает комиссию, нужно немного подождать и ещё раз прочитать журнал за ночь. При большой нагрузке лучше, чтобы резервная копия начиналась раньше, потому что никто не знает, когда придёт следующий блок.",
    "nl": "Als de node de kosten niet kent, moet je even wachten en het logboek van de nacht nog een keer lezen. Bij veel belasting is het beter dat de kopie eerder begint, want niemand weet wanneer het volgende blok komt.",
    "it": "Se il nodo non conosce la commissione, si deve aspettare un poco e leggere ancora una volta il registro della notte. Con molto carico è meglio che la copia inizi prima, perché nessuno sa quando arriva il blocco.",
    "pt": "Se o nó não conhece a taxa, é preciso esperar um pouco e ler mais uma vez o registro da noite. Com muita carga é melhor que a cópia comece antes, porque ninguém sabe quando chega o próximo bloco.",
    "pl": "Jeśli węzeł nie zna opłaty, to trzeba poczekać i jeszcze raz przeczytać dziennik z nocy. Przy dużym obciążeniu lepiej, by kopia była gotowa wcześniej, bo nikt nie wie, kiedy przyjdzie ten blok, a to już za późno.",
    "sv": "Om noden inte vet vad avgiften är, så ska man vänta en stund och läsa loggen från natten en gång till. Vid hög last är det bättre att kopian börjar tidigare, för ingen vet när nästa block kommer, och då är det för sent.",
}


def test_prose_of_further_languages():
    for lang, t in FURTHER.items():
        for text in (t, f"{t}\n" * 3, f"{t} " * 3):
            got, share = shares(text)
            assert got == [lang] and share.max() < 0.2, lang
        spam = "cheap wallet airdrop promo code free bonus coins " * 20
        assert shares(t + "\n" + spam)[1][0][stuffing.USUAL] > 0.5


def test_learned_language(spark):
    lines = ["ve bu da bir kopya ile gece oldu ama node yok", "bu gece bir blok da geldi ve ama log ile yok", "ama bir hata da ile oldu ve bu kez kayıt yok"]
    rows = [(i, "\n".join(lines[i % 3 :] + lines[: i % 3]) * 3, "tr") for i in range(6)] + [(9, "plain words of a page that is in the usual language and has no need of a list", "en"), (10, None, "tr"), (11, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = stuffing.learned_words(df)
    assert set(learned) == {"tr"} and {"ve", "bu", "da", "bir", "ama"} <= learned["tr"]
    assert stuffing.stuffed_pages(df).count() == 0
    assert {r.lang for r in stuffing.stuffing(df.where("lang = 'tr' and text is not null")).collect()} == {"tr"}
    assert stuffing.learned_words(df.where("lang = 'en'")) == {} == stuffing.learned_words(df.limit(0))


def test_words_of_tags_are_no_sentences():
    tags = ["gagner de l'argent", "sans inscription", "acheter des jetons", "robot de trading", "paiement rapide"]
    for form in ("\n".join(f"{p}{t}" for t in tags for p in ("tags=", "keyword: ", "rel:")), "; ".join(f"tag:{t}" for t in tags * 3)):
        assert share(form) > 0.9
    assert share("A tag: that is what we call the mark which is put on each of the rows, so that one can find them. " * 2) < 0.2


def test_signs():
    links, lines = "\n".join(f"https://shop.name{i}.example/a" for i in range(12)), "\n".join(["cheap wallet promo airdrop", "cold store gift card"] * 6)
    of = lambda t: dict(zip(stuffing.SIGNS, stuffing.stuffed_shares([stuffing.Page(t)], [None])[2][0]))
    assert of(links)["links"] == 1
    got = of(lines)
    assert got["repeated"] == 40 / 48 and got["top words"] == 1 and abs(got["duplicate lines"] - 40 / 48) < 1e-9 and got["n-grams"] > 0.8 and got["separators"] == 0
    assert of(", ".join(WORDS))["separators"] > 0.9 and of(", ".join(WORDS))["repeated"] == 0
    assert max(of(PROSE["en"]).values()) == 0
