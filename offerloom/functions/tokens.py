"""Word forms, spelling variants and synonyms of search words, as Column expressions.

Every dictionary is a parameter with a default, so a user can bring other words.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.functions.literals import literal_array, literal_rows
from offerloom.functions.text import words

# The forms of grocery words in search spelling, one group per line; a word alone has no other form.
WORD_FORMS: list[tuple[str, ...]] = [
    ("apfel", "aepfel"),
    ("tafelapfel", "tafelaepfel"),
    ("banane", "bananen"),
    ("orange", "orangen"),
    ("zitrone", "zitronen"),
    ("traube", "trauben"),
    ("kirsche", "kirschen"),
    ("birne", "birnen"),
    ("pflaume", "pflaumen"),
    ("himbeere", "himbeeren"),
    ("erdbeere", "erdbeeren"),
    ("blaubeere", "blaubeeren"),
    ("heidelbeere", "heidelbeeren"),
    ("mango", "mangos"),
    ("avocado", "avocados"),
    ("kiwi", "kiwis"),
    ("clementine", "clementinen"),
    ("mandarine", "mandarinen"),
    ("nektarine", "nektarinen"),
    ("ananas", "ananasse"),
    ("tomate", "tomaten"),
    ("kartoffel", "kartoffeln"),
    ("zwiebel", "zwiebeln"),
    ("gurke", "gurken"),
    ("karotte", "karotten"),
    ("moehre", "moehren"),
    ("paprika", "paprikas"),
    ("zucchini", "zucchinis"),
    ("aubergine", "auberginen"),
    ("bohne", "bohnen"),
    ("erbse", "erbsen"),
    ("linse", "linsen"),
    ("olive", "oliven"),
    ("radieschen",),
    ("champignon", "champignons"),
    ("pilz", "pilze"),
    ("wurst", "wuerste", "wuerstchen"),
    ("bratwurst", "bratwuerste"),
    ("rostbratwurst", "rostbratwuerste"),
    ("currywurst", "currywuerste"),
    ("steak", "steaks"),
    ("filet", "filets"),
    ("schnitzel",),
    ("haehnchen", "huhn", "huehnchen", "huehner"),
    ("haehnchenbrustfilet", "haehnchenbrustfilets"),
    ("schinken",),
    ("wuerstchen",),
    ("frikadelle", "frikadellen"),
    ("bulette", "buletten"),
    ("garnele", "garnelen"),
    ("joghurt", "joghurts", "jogurt", "jogurts", "yoghurt", "yoghurts"),
    ("kaese",),
    ("milch",),
    ("butter",),
    ("sahne",),
    ("quark",),
    ("brot", "brote", "broetchen"),
    ("broetchen",),
    ("brezel", "brezeln"),
    ("croissant", "croissants"),
    ("kuchen",),
    ("torte", "torten"),
    ("semmel", "semmeln"),
    ("nudel", "nudeln"),
    ("spaghetti",),
    ("reis",),
    ("mehl",),
    ("zucker",),
    ("salz",),
    ("oel", "oele"),
    ("essig",),
    ("nuss", "nuesse"),
    ("haselnuss", "haselnuesse"),
    ("walnuss", "walnuesse"),
    ("erdnuss", "erdnuesse"),
    ("mandel", "mandeln"),
    ("wasser", "waesser"),
    ("saft", "saefte"),
    ("apfelsaft", "apfelsaefte"),
    ("orangensaft", "orangensaefte"),
    ("limonade", "limonaden"),
    ("bier", "biere"),
    ("wein", "weine"),
    ("flasche", "flaschen"),
    ("dose", "dosen"),
    ("packung", "packungen"),
    ("beutel",),
    ("stueck",),
    ("scheibe", "scheiben"),
    ("glas", "glaeser"),
    ("becher",),
    ("tafel", "tafeln"),
    ("riegel",),
    ("ei", "eier"),
    ("pfeffer",),
    ("gewuerz", "gewuerze"),
    ("chips",),
    ("keks", "kekse"),
    ("praline", "pralinen"),
    ("schokolade", "schokoladen"),
    ("bonbon", "bonbons"),
    ("muesli", "mueslis"),
    ("pizza", "pizzen", "pizzas"),
    ("tiefkuehlpizza", "tiefkuehlpizzen"),
    ("waffel", "waffeln"),
    ("pfannkuchen",),
]
# Short forms and the words they stand for, in the order they are tried.
ABBREVIATIONS: list[tuple[str, str]] = [
    ("h milch", "haltbare milch"),
    ("tk", "tiefkuehl"),
    ("bio milch", "biomilch"),
    ("tiefkuehlpizza", "tiefkuehl pizza"),
    ("tiefkuehlkost", "tiefkuehl kost"),
    ("tiefkuehlgemuese", "tiefkuehl gemuese"),
    ("aufbackbroetchen", "aufback broetchen"),
    ("orangensaft", "orangen saft"),
    ("apfelsaft", "apfel saft"),
    ("hundefutter", "hunde futter"),
    ("katzenfutter", "katzen futter"),
    ("alufolie", "alu folie"),
    ("frischhaltefolie", "frischhalte folie"),
]
# Words meaning the same when texts are scored.
SCORING_SYNONYMS: list[tuple[str, str]] = [
    ("marmelade", "konfituere"),
    ("zahnpasta", "zahncreme"),
    ("weintrauben", "trauben"),
    ("weintraube", "traube"),
    ("wodka", "vodka"),
    ("broetchen", "semmel"),
    ("broetchen", "schrippe"),
    ("quark", "topfen"),
    ("sahne", "rahm"),
    ("sahne", "obers"),
    ("hackfleisch", "faschiertes"),
    ("hackfleisch", "gehacktes"),
    ("kartoffel", "erdapfel"),
    ("tomate", "paradeiser"),
    ("aprikose", "marille"),
    ("blumenkohl", "karfiol"),
    ("meerrettich", "kren"),
    ("pfannkuchen", "eierkuchen"),
    ("pfannkuchen", "palatschinken"),
    ("joghurt", "jogurt"),
    ("joghurt", "yoghurt"),
    ("ketchup", "ketschup"),
    ("thunfisch", "tunfisch"),
    ("mayonnaise", "majonnaese"),
    ("mozzarella", "mozzarela"),
    ("klopapier", "toilettenpapier"),
    ("spueli", "spuelmittel"),
    ("limo", "limonade"),
    ("pommes", "pommes frites"),
    ("wuerstchen", "wiener"),
]
# The pairs that also widen the candidate search of a basket line.
BLOCKING_SYNONYMS = SCORING_SYNONYMS[:5]
# Groups whose members replace each other in a category search.
SYNONYM_GROUPS: list[tuple[str, ...]] = [
    ("klopapier", "toilettenpapier"),
    ("spüli", "spülmittel"),
    ("spueli", "spuelmittel"),
    ("limo", "limonade"),
    ("pommes", "pommes frites", "fritten"),
    ("brötchen", "semmel", "schrippe"),
    ("broetchen", "semmel", "schrippe"),
    ("pfannkuchen", "eierkuchen", "palatschinken"),
    ("tk", "tiefkühl", "tiefkuehl"),
    ("joghurt", "jogurt"),
    ("ketchup", "ketschup"),
    ("hackfleisch", "gehacktes", "faschiertes"),
    ("sahne", "rahm"),
    ("quark", "topfen"),
    ("marmelade", "konfitüre", "konfituere"),
    ("paprika", "peperoni"),
    ("aprikose", "marille"),
    ("blumenkohl", "karfiol"),
    ("tomate", "paradeiser"),
    ("pfifferlinge", "eierschwammerl"),
    ("meerrettich", "kren"),
    ("pflaumen", "zwetschgen", "zwetschken"),
    ("berliner", "krapfen"),
    ("feldsalat", "rapunzel", "nüsslisalat", "nuessisalat"),
    ("aubergine", "melanzani"),
]
# Specific word -> wider words, one direction only.
WIDER_TERMS: list[tuple[str, tuple[str, ...]]] = [
    ("schlagrahm", ("sahne", "rahm")),
    ("vollmilch", ("milch",)),
    ("buttermilch", ("milch",)),
    ("hafermilch", ("milch", "haferdrink")),
    ("sojamilch", ("milch", "sojadrink")),
    ("espresso", ("kaffee",)),
    ("cappuccino", ("kaffee",)),
    ("latte macchiato", ("kaffee",)),
    ("weizenbier", ("bier",)),
    ("pils", ("bier",)),
    ("rotwein", ("wein",)),
    ("weisswein", ("wein",)),
    ("orangensaft", ("saft",)),
    ("apfelsaft", ("saft",)),
    ("multivitaminsaft", ("saft",)),
    ("schwarztee", ("tee",)),
    ("gruentee", ("tee",)),
    ("fruechtetee", ("tee",)),
    ("cheddar", ("kaese",)),
    ("gouda", ("kaese",)),
    ("mozzarella", ("kaese",)),
    ("emmentaler", ("kaese",)),
    ("salami", ("wurst",)),
    ("leberwurst", ("wurst",)),
    ("bratwurst", ("wurst",)),
    ("spaghetti", ("nudeln", "pasta")),
    ("penne", ("nudeln", "pasta")),
    ("fusilli", ("nudeln", "pasta")),
    ("basmati", ("reis",)),
    ("jasminreis", ("reis",)),
]
# Fixed values: (pattern, replacement, the short form put back in the other direction).
PHRASE_SYNONYMS: list[tuple[str, str, str]] = [
    (r"\bh\s*milch", "haltbare milch", "h milch"),
    (r"\bhmilch", "haltbare milch", "hmilch"),
    (r"\bh\s*vollmilch", "haltbare vollmilch", "h vollmilch"),
]
# Letter pairs that may stand for an umlaut, and stems where they do not.
UMLAUT_PAIRS = [("ae", "ä"), ("oe", "ö"), ("ue", "ü"), ("ss", "ß")]
NOT_UMLAUT: dict[str, list[str]] = {
    "ae": ["israel", "michael", "raphael", "aegypten"],
    "oe": ["poet", "boeing", "aloe", "canoe", "oboe"],
    "ue": [
        "abenteuer", "steuer", "feuer", "teuer", "ungeheuer", "heuer", "scheuer", "treue", "neue", "reue",
        "bauer", "lauer", "mauer", "sauer", "trauer", "dauer", "schauer", "knauer",
    ],
}
# Words that ask for deals rather than for a product.
DEAL_WORDS = [
    "rabatt", "angebot", "angebote", "günstig", "guenstig", "billig", "deal", "deals", "sale", "aktion", "aktionen",
    "sonderangebot", "sonderangebote", "schnäppchen", "schnaeppchen",
]


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def _ends(text: Column, *endings: str) -> Column:
    hit = F.endswith(text, F.lit(endings[0]))
    for ending in endings[1:]:
        hit = hit | F.endswith(text, F.lit(ending))
    return hit


def _drop_last(text: Column, count: int = 1) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - count)


def _keyword_forms(seed: Column) -> list[Column]:
    low, size = F.lower(seed), F.length(seed)
    vowel_e, closed, vowel = _ends(low, "e"), _ends(low, "el", "er", "en"), _ends(low, "a", "i", "o", "u")
    other = ~(vowel_e | closed | vowel)
    on_n = _ends(low, "n") & (size > 2)
    return [
        _capital(seed),
        seed,
        F.when(vowel_e, _capital(F.concat(seed, F.lit("n")))),
        F.when(~vowel_e & ~closed & vowel, _capital(F.concat(seed, F.lit("s")))),
        F.when(other, _capital(F.concat(seed, F.lit("e")))),
        F.when(other, _capital(F.concat(seed, F.lit("en")))),
        F.when((_ends(low, "en") & (size > 3)) | (~on_n & _ends(low, "s") & (size > 2)), _capital(_drop_last(seed))),
    ]


def keyword_variants(keyword: Column) -> Column:
    """Ordered, unique spellings of a keyword: capitalised, plural, singular, without umlauts."""
    base = F.trim(keyword)
    ascii_form = base
    for letter, spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")):
        ascii_form = F.replace(ascii_form, F.lit(letter), F.lit(spelled))
    forms = _keyword_forms(base) + [F.when(ascii_form != base, f) for f in _keyword_forms(ascii_form)]
    unique = F.array_distinct(F.array_compact(F.array(*forms)))
    return F.when(base != "", unique).otherwise(F.array().cast("array<string>"))


def _rule_forms(token: Column) -> Column:
    n = F.length(token)
    cut = [
        F.when((n > 4) & _ends(token, "en"), _drop_last(token, 2)),
        F.when(((n > 4) & _ends(token, "en")) | ((n > 3) & _ends(token, "n")), _drop_last(token)),
        F.when((n > 3) & _ends(token, "e"), _drop_last(token)),
        F.when((n > 4) & _ends(token, "er"), _drop_last(token, 2)),
        F.when((n > 3) & _ends(token, "s"), _drop_last(token)),
    ]
    grown = [F.concat(token, F.lit(ending)) for ending in ("n", "en", "e", "er", "s")]
    candidates = F.filter(F.array_compact(F.array(*cut, *grown)), lambda v: (F.length(v) >= 2) & (v != token))
    ordered = F.array_sort(F.transform(F.array_distinct(candidates), lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))
    return F.transform(F.slice(ordered, 1, 4), lambda s: s["v"])


def form_map(forms: list[tuple[str, ...]] | None = None) -> list[tuple[str, list[str]]]:
    """Each known form with all forms of its groups, in dictionary order."""
    table: dict[str, list[str]] = {}
    for group in WORD_FORMS if forms is None else forms:
        for form in group:
            known = table.setdefault(form, [])
            known.extend(f for f in group if f not in known)
    return list(table.items())


def token_forms(token: Column, forms: list[tuple[str, ...]] | None = None) -> Column:
    """Sorted set of forms of a word: dictionary, else dictionary as the end of a compound, else rules."""
    table = literal_rows(["form", "all"], form_map(forms))
    exact = F.get(F.filter(table, lambda e: e["form"] == token), F.lit(0))
    compound = F.get(
        F.filter(table, lambda e: F.endswith(token, e["form"]) & (F.length(token) > F.length(e["form"])) & (F.size(e["all"]) > 1)), F.lit(0)
    )
    stem = F.substring(token, F.lit(1), F.length(token) - F.length(compound["form"]))
    found = (
        F.when(exact.isNotNull(), exact["all"])
        .when(compound.isNotNull(), F.transform(compound["all"], lambda s: F.concat(stem, s)))
        .otherwise(_rule_forms(token))
    )
    return F.array_sort(F.array_distinct(F.concat(F.array(token), found)))


def umlaut_variants(text: Column) -> Column:
    """Spellings with umlauts put in or taken out, fewest replacements first, at most seven."""
    options = []
    for plain, umlaut in UMLAUT_PAIRS:
        stems = NOT_UMLAUT.get(plain)
        blocked = F.exists(literal_array(stems), lambda stem: F.contains(text, stem)) if stems else F.lit(False)
        options.append(F.when(F.contains(text, F.lit(plain)) & ~blocked, F.struct(F.lit(plain).alias("src"), F.lit(umlaut).alias("dst"))))
        options.append(F.when(F.contains(text, F.lit(umlaut)), F.struct(F.lit(umlaut).alias("src"), F.lit(plain).alias("dst"))))
    chosen = F.slice(F.array_compact(F.array(*options)), 1, 4)
    subsets = literal_array(list(c) for size in (1, 2, 3, 4) for c in combinations(range(4), size))
    usable = F.filter(subsets, lambda s: F.array_max(s) < F.size(chosen))
    spelled = F.transform(
        usable,
        lambda s: F.aggregate(s, text, lambda acc, i: F.replace(acc, F.get(chosen, i)["src"], F.get(chosen, i)["dst"])),
    )
    return F.slice(F.array_distinct(F.filter(spelled, lambda v: v != text)), 1, 7)


def synonym_variants(text: Column) -> Column:
    """Other wordings of a query by phrase, group and wider-term synonyms, in that order."""
    phrases = []
    for pattern, long_form, short_form in PHRASE_SYNONYMS:
        phrases += [F.regexp_replace(text, pattern, long_form), F.replace(text, F.lit(long_form), F.lit(short_form))]
    swaps = [(a, b) for group in SYNONYM_GROUPS for a in group for b in group if a != b]
    widen = [(a, b) for a, wider in WIDER_TERMS for b in wider]

    def replaced(pairs: list[tuple[str, str]]) -> Column:
        table = literal_rows(["a", "b"], pairs)
        tokens = F.split(F.lower(text), " ")
        return F.flatten(
            F.transform(
                tokens,
                lambda tok, i: F.transform(
                    F.filter(table, lambda p: p["a"] == tok),
                    lambda p: F.array_join(F.transform(tokens, lambda t, j: F.when(j == i, p["b"]).otherwise(t)), " "),
                ),
            )
        )

    spaced = [F.when(F.contains(text, F.lit(a)), F.replace(text, F.lit(a), F.lit(b))) for a, b in widen if " " in a]
    everything = F.concat(F.array(*phrases), replaced(swaps), replaced(widen), F.array(*spaced))
    return F.array_distinct(F.filter(F.array_compact(everything), lambda v: v != text))


def expand_abbreviation(text: Column) -> Column:
    """Replace the first abbreviation, in dictionary order, that occurs as whole words."""
    hits = [
        F.when(text.rlike(f"(?:^| ){short}(?: |$)"), F.regexp_replace(text, f"(^| ){short}(?= |$)", f"$1{full}"))
        for short, full in ABBREVIATIONS
    ]
    return F.coalesce(*hits, text)


def asks_for_deals(query: Column) -> Column:
    return F.arrays_overlap(words(F.lower(query)), literal_array(DEAL_WORDS))


def without_deal_words(query: Column) -> Column:
    return F.array_join(F.filter(words(F.lower(query)), lambda w: ~w.isin(*DEAL_WORDS)), " ")


def typo_patterns(token: Column, limit: int | None = None, longest: int | None = None) -> Column:
    """Patterns within one edit: deletions, then `_` in place of a letter, then `_` between letters.

    ``limit`` keeps the first patterns only, ``longest`` gives longer words none.
    """
    n = F.length(token)

    def cut(i: Column, fill: str, skip: int) -> Column:
        return F.concat(F.substring(token, F.lit(1), i), F.lit(fill), F.substring(token, i + 1 + skip, n))

    places = F.sequence(F.lit(0), n - 1)
    drop = F.filter(F.transform(places, lambda i: cut(i, "", 1)), lambda v: F.length(v) >= 2)
    swap = F.transform(places, lambda i: cut(i, "_", 1))
    grow = F.transform(F.sequence(F.lit(0), n), lambda i: cut(i, "_", 0))
    patterns = F.array_distinct(F.concat(drop, swap, grow))
    if limit is not None:
        patterns = F.slice(patterns, 1, limit)
    found = F.when(n < 3, F.array(token)).otherwise(patterns)
    return found if longest is None else F.when(n <= longest, found).otherwise(F.array().cast("array<string>"))
