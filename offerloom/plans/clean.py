"""Queries over cleaning, normalisation and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import chains, numbers, text, tokens, units
from offerloom.functions.literals import literal_array
from offerloom.operators.catalog import with_base_prices
from offerloom.plans.registry import query
from offerloom.plans.sqltext import base_vowel_sql, norm_sql, squeeze_sql
from offerloom.plans.sqlunits import base_price_select_sql, number_sql, quantity_struct_sql, unit_attribute_sql
from offerloom.plans.views import Tables

# Names under which stores of the test tables are registered, chosen by key.
STORE_NAMES = [
    "ALDI SÜD", "Aldi Nord Filiale", "aldi-nord", "Lidl", "REWE City", "Nahkauf Meier", "E-Center", "EDEKA Center West",
    "Netto Marken-Discount", "Penny-Markt", "penny markt", "Kaufland SB", "NORMA", "Globus Baumarkt", "Marktkauf", "Tante Emma", "",
]
GERMAN_TERMS = [
    "brötchen", "broetchen", "h milch", "hmilch", "latte macchiato", "orangensaft", "kaese", "tk pizza", "nuesse", "müsli",
    "steuer", "abenteuer kekse", "vollmilch", "haltbare milch", "spaghetti", "marmelade", "grösse", "aepfel", "weintrauben",
    "rabatt butter", "günstig kaffee", "sale", "bio milch", "tiefkuehlpizza",
]


def _lit_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values: list[str], key):
    """Element of a list chosen by a numeric key, a column or its name."""
    number = F.col(key) if isinstance(key, str) else key
    return F.element_at(literal_array(values), (number % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], key: str) -> str:
    return f"{_lit_list(values)}[({key} % {len(values)}) + 1]"


@query("nrm1_mojibake_repair", "SELECT doc_id, md5(text) AS repaired FROM documents")
def _(t: Tables):
    garbled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return t.read("documents").select("doc_id", F.md5(text.repair_mojibake(garbled)).alias("repaired"))


@query("nrm2_compact_text", f"SELECT doc_id, md5({squeeze_sql('text')}) AS compact FROM documents")
def _(t: Tables):
    return t.read("documents").select("doc_id", F.md5(text.squeeze(F.col("text"))).alias("compact"))


@query("nrm3_search_text", f"SELECT doc_id, md5({norm_sql('text')}) AS normalized FROM documents")
def _(t: Tables):
    return t.read("documents").select("doc_id", F.md5(text.normalize_search_text(F.col("text"))).alias("normalized"))


@query("nrm4_base_vowel_text", f"SELECT doc_id, md5({base_vowel_sql('text')}) AS normalized FROM documents")
def _(t: Tables):
    return t.read("documents").select("doc_id", F.md5(text.base_vowel_text(F.col("text"))).alias("normalized"))


def _chain_case_sql(low: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({low}, '{p}') THEN '{n}'" for p, n in chains.CHAIN_PARTS) + " END"


def _alias_case_sql(low: str) -> str:
    return f"coalesce(CASE {low} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in chains.CHAIN_ALIASES.items()) + f" END, {_chain_case_sql(low)})"


@query(
    "nrm5_chain_name",
    f"SELECT c_custkey AS store_id, {_alias_case_sql('lower(trim(raw))')} AS chain FROM (SELECT c_custkey, {_pick_sql(STORE_NAMES, 'c_custkey')} AS raw FROM customer)",
)
def _(t: Tables):
    return t.read("customer").select(F.col("c_custkey").alias("store_id"), chains.canonical_chain(_pick(STORE_NAMES, "c_custkey")).alias("chain"))


@query(
    "nrm6_chain_from_tags",
    f"""SELECT store_id, coalesce({_chain_case_sql("lower(brand || ' ' || operator || ' ' || name)")}, 'Sonstige') AS chain FROM (
SELECT c_custkey AS store_id, {_pick_sql(STORE_NAMES, 'c_custkey')} AS brand, c_mktsegment AS operator, {_pick_sql(STORE_NAMES, 'c_nationkey')} AS name FROM customer)""",
)
def _(t: Tables):
    tagged = chains.chain_of_tags(_pick(STORE_NAMES, "c_custkey"), F.col("c_mktsegment"), _pick(STORE_NAMES, "c_nationkey"))
    return t.read("customer").select(F.col("c_custkey").alias("store_id"), tagged.alias("chain"))


@query(
    "nrm7_territory",
    f"""SELECT territory, count(*) AS n FROM (SELECT CASE WHEN contains(up, 'ALDI SÜD') OR contains(up, 'ALDI SUED') THEN 'sued'
WHEN contains(up, 'ALDI NORD') OR contains(up, 'ALDI-NORD') THEN 'nord' END AS territory
FROM (SELECT upper({_pick_sql(STORE_NAMES, 'c_custkey')}) AS up FROM customer)) GROUP BY territory""",
)
def _(t: Tables):
    named = t.read("customer").select(chains.territory(_pick(STORE_NAMES, "c_custkey")).alias("territory"))
    return named.groupBy("territory").agg(F.count(F.lit(1)).alias("n"))


@query(
    "nrm8_chain_fallback",
    f"""SELECT store_id, coalesce({_alias_case_sql('lower(trim(p))')}, {_alias_case_sql('lower(trim(k))')}, {_alias_case_sql('lower(trim(f))')},
 upper(f[1]) || f[2:4] || ' ' || upper(f[6]) || f[7:]) AS chain
FROM (SELECT c_custkey AS store_id, {_pick_sql(STORE_NAMES, 'c_custkey')} AS p, CASE WHEN c_nationkey % 2 = 0 THEN 'penny' ELSE 'unknown' END AS k,
 'shop-' || lower(c_mktsegment) AS f FROM customer)""",
)
def _(t: Tables):
    key = F.when(F.col("c_nationkey") % 2 == 0, "penny").otherwise("unknown")
    folder = F.concat(F.lit("shop-"), F.lower("c_mktsegment"))
    chain = chains.chain_with_fallback(_pick(STORE_NAMES, "c_custkey"), key, folder)
    return t.read("customer").select(F.col("c_custkey").alias("store_id"), chain.alias("chain"))


_NUMBER_TEXT_SQL = """CASE l_linenumber WHEN 1 THEN replace(l_extendedprice::VARCHAR, '.', ',') WHEN 2 THEN (l_partkey % 900 + 1)::VARCHAR || '.-'
 WHEN 3 THEN (l_orderkey % 9 + 1)::VARCHAR || '.' || lpad((l_partkey % 1000)::VARCHAR, 3, '0')
 WHEN 4 THEN (l_orderkey % 9 + 1)::VARCHAR || '.' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') || ',' || (l_suppkey % 90 + 10)::VARCHAR
 WHEN 5 THEN l_extendedprice::VARCHAR WHEN 6 THEN (l_partkey % 900)::VARCHAR || '.' ELSE '1.2.3' END"""


@query(
    "nrm9_german_number",
    f"SELECT l_orderkey, l_partkey, l_suppkey, {number_sql('x')} AS number FROM (SELECT *, {_NUMBER_TEXT_SQL} AS x FROM lineitem)",
)
def _(t: Tables):
    def s(c):
        return c.cast("string")

    form, thousand = F.col("l_linenumber"), F.lpad(s(F.col("l_partkey") % 1000), 3, "0")
    price = s(F.format_string("%.2f", "l_extendedprice"))
    price = F.regexp_replace(F.regexp_replace(price, r"(\.\d)0$", "$1"), r"^(\d+)$", "$1.0")
    lead = s(F.col("l_orderkey") % 9 + 1)
    printed = (
        F.when(form == 1, F.replace(price, F.lit("."), F.lit(",")))
        .when(form == 2, F.concat(s(F.col("l_partkey") % 900 + 1), F.lit(".-")))
        .when(form == 3, F.concat(lead, F.lit("."), thousand))
        .when(form == 4, F.concat(lead, F.lit("."), thousand, F.lit(","), s(F.col("l_suppkey") % 90 + 10)))
        .when(form == 5, price)
        .when(form == 6, F.concat(s(F.col("l_partkey") % 900), F.lit(".")))
        .otherwise("1.2.3")
    )
    return t.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", units.german_number(printed).alias("number"))


@query(
    "nrm10_unit_price",
    "SELECT offer_id, quantity, unit, unit_group, price, normalized_unit, floor(ppn * 1e9 + 0.5::DOUBLE) AS ppn_nano FROM ("
    + base_price_select_sql("base_price_text", "raw_offers", "offer_id") + ")",
)
def _(t: Tables):
    parsed = with_base_prices(t.raw_offers.select("offer_id", "base_price_text"), "base_price_text", "u")
    return parsed.select(
        "offer_id", "u.quantity", "u.unit", "u.unit_group", "u.price", "u.normalized_unit",
        F.floor(F.col("u.price_per_normalized") * 1e9 + 0.5).cast("double").alias("ppn_nano"),
    )


@query(
    "nrm11_description_quantity",
    f"""SELECT offer_id, q.quantity AS quantity, q.unit AS unit, {unit_attribute_sql('q.unit', 0)} AS unit_group,
 floor(sales_price / (q.quantity * {unit_attribute_sql('q.unit', 1)}) * 1e9 + 0.5::DOUBLE) AS ppn_nano
FROM (SELECT offer_id, sales_price, {quantity_struct_sql('description')} AS q FROM raw_offers WHERE base_price_text IS NULL)""",
)
def _(t: Tables):
    empty = t.raw_offers.where(F.col("base_price_text").isNull())
    unit = units.enrich_unit_price(F.col("base_price_text"), F.col("description"), F.col("sales_price"))
    return empty.select("offer_id", unit.alias("u")).select(
        "offer_id", "u.quantity", "u.unit", "u.unit_group", F.floor(F.col("u.price_per_normalized") * 1e9 + 0.5).cast("double").alias("ppn_nano")
    )


@query(
    "nrm12_comparable_offers",
    """SELECT o.chain, count(*) AS pairs, sum(CASE WHEN o.unit_group = r.unit_group AND o.ppn IS NOT NULL AND r.ppn IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS comparable
FROM offers o JOIN (SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY product_key ORDER BY offer_id) = 1) r USING (product_key) GROUP BY o.chain""",
)
def _(t: Tables):
    first = t.offers.groupBy("product_key").agg(F.min_by(F.struct("unit_group", "ppn"), "offer_id").alias("r"))
    same = units.comparable(F.col("unit_group"), F.col("ppn"), F.col("r.unit_group"), F.col("r.ppn"))
    return t.offers.join(first, "product_key").groupBy("chain").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(same.cast("bigint")).alias("comparable")
    )


@query(
    "nrm13_display_unit_price",
    f"""SELECT offer_id, {numbers.round_to_sql("CASE WHEN unit IN ('g', 'ml') THEN price / quantity * 1000::DOUBLE ELSE price / quantity END", 2)} AS value,
 CASE WHEN unit IN ('g', 'kg') THEN 'kg' WHEN unit IN ('ml', 'l', 'liter') THEN 'l' ELSE unit END AS unit_label
FROM ({base_price_select_sql('base_price_text', 'raw_offers', 'offer_id')})""",
)
def _(t: Tables):
    parsed = with_base_prices(t.raw_offers.select("offer_id", "base_price_text"), "base_price_text", "u")
    shown = units.display_unit_price(F.col("u.price"), F.col("u.unit"), F.col("u.quantity"))
    return parsed.select("offer_id", shown.alias("d")).select("offer_id", numbers.round_to(F.col("d.value"), 2).alias("value"), F.col("d.unit").alias("unit_label"))


@query("nrm14_sane_was_price", "SELECT offer_id, CASE WHEN regular_price > sales_price THEN regular_price END AS was_price FROM raw_offers")
def _(t: Tables):
    return t.raw_offers.select("offer_id", numbers.sane_was_price(F.col("regular_price"), F.col("sales_price")).alias("was_price"))


@query(
    "nrm15_discount_percent",
    """SELECT offer_id, CASE WHEN regular_price > 0 AND sales_price >= 0 AND regular_price > sales_price
THEN round_even((1::DOUBLE - sales_price / regular_price) * 100::DOUBLE, 0)::BIGINT END AS discount FROM raw_offers""",
)
def _(t: Tables):
    return t.raw_offers.select("offer_id", numbers.discount_percent(F.col("sales_price"), F.col("regular_price")).alias("discount"))


@query(
    "nrm16_valid_offers",
    """SELECT chain, count(*) AS valid_offers FROM (SELECT chain, CASE WHEN page_number <> 1 THEN valid_from END AS f, CASE WHEN page_number <> 2 THEN valid_until END AS u
FROM raw_offers) WHERE coalesce(f <= DATE '1998-06-15', true) AND coalesce(DATE '1998-06-15' <= u, true) GROUP BY chain""",
)
def _(t: Tables):
    open_start = F.when(F.col("page_number") != 1, F.col("valid_from"))
    open_end = F.when(F.col("page_number") != 2, F.col("valid_until"))
    day = F.lit("1998-06-15").cast("date")
    return t.raw_offers.where(numbers.valid_on(open_start, open_end, day)).groupBy("chain").agg(F.count(F.lit(1)).alias("valid_offers"))


@query(
    "nrm17_city_slug",
    """SELECT c_custkey AS store_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(city, '\\s*\\([^)]*\\)', '', 'g'),
 ' / ', '-'), '/', '-'), ' - ', '-'), ' ', '-'), '[^\\w\\-äöüÄÖÜß]', '', 'g'), '-+', '-', 'g'), '-') AS slug
FROM (SELECT c_custkey, 'Bad ' || c_mktsegment || ' (Süd) / Köln - St. ' || c_nationkey::VARCHAR AS city FROM customer)""",
)
def _(t: Tables):
    city = F.concat(F.lit("Bad "), "c_mktsegment", F.lit(" (Süd) / Köln - St. "), F.col("c_nationkey").cast("string"))
    return t.read("customer").select(F.col("c_custkey").alias("store_id"), text.city_slug(city).alias("slug"))


def _forms_sql(seed: str) -> str:
    def cap(x: str) -> str:
        return f"(regexp_replace(upper(substr({x}, 1, 1)), '[ßẞ]', 'SS') || substr({x}, 2))"

    low = f"lower({seed})"
    e, closed = f"{low} LIKE '%e'", f"({low} LIKE '%el' OR {low} LIKE '%er' OR {low} LIKE '%en')"
    vowel = f"({low} LIKE '%a' OR {low} LIKE '%i' OR {low} LIKE '%o' OR {low} LIKE '%u')"
    other = f"NOT ({e} OR {closed} OR {vowel})"
    cut = f"substr({seed}, 1, length({seed}) - 1)"
    return (
        f"{cap(seed)}, {seed}, CASE WHEN {e} THEN {cap(f'({seed} || chr(110))')} END, CASE WHEN NOT ({e}) AND NOT {closed} AND {vowel} THEN {cap(f'({seed} || chr(115))')} END, "
        f"CASE WHEN {other} THEN {cap(f'({seed} || chr(101))')} END, CASE WHEN {other} THEN {cap(f'({seed} || chr(101) || chr(110))')} END, "
        f"CASE WHEN {low} LIKE '%en' AND length({seed}) > 3 THEN {cap(cut)} WHEN {low} LIKE '%n' AND length({seed}) > 2 THEN NULL "
        f"WHEN {low} LIKE '%s' AND length({seed}) > 2 THEN {cap(cut)} END"
    )


_VOCABULARY_SQL = "SELECT DISTINCT unnest(regexp_extract_all(text, '[a-zA-ZäöüÄÖÜß]+')) AS word FROM documents"


def _vocabulary(t: Tables):
    """Distinct words as written in the documents."""
    found = F.regexp_extract_all("text", F.lit("[a-zA-ZäöüÄÖÜß]+"), F.lit(0))
    return t.read("documents").select(F.explode(found).alias("word")).distinct()


@query(
    "nrm19_keyword_variants",
    f"""SELECT word, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') AS variants FROM (SELECT word,
 list_filter([{_forms_sql('word')}] || CASE WHEN a <> word THEN [{_forms_sql('a')}] ELSE [] END, lambda x: x IS NOT NULL) AS v
 FROM (SELECT word, replace(replace(replace(replace(replace(replace(replace(word, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss') AS a
 FROM ({_VOCABULARY_SQL})))""",
)
def _(t: Tables):
    return _vocabulary(t).select("word", F.array_join(tokens.keyword_variants(F.col("word")), "|").alias("variants"))


def token_forms_sql(token: str) -> str:
    """Sorted list of the forms of a word."""
    table = tokens.form_map()
    exact = " ".join(f"WHEN {token} = '{f}' THEN {_lit_list(s)}" for f, s in table)
    compound = " ".join(
        f"WHEN suffix({token}, '{f}') AND length({token}) > {len(f)} THEN list_transform({_lit_list(s)}, lambda z: substr({token}, 1, length({token}) - {len(f)}) || z)"
        for f, s in table if len(s) > 1
    )
    n, cut = f"length({token})", lambda k: f"substr({token}, 1, length({token}) - {k})"
    rules = [
        f"CASE WHEN {n} > 4 AND suffix({token}, 'en') THEN {cut(2)} END",
        f"CASE WHEN {n} > 4 AND suffix({token}, 'en') THEN {cut(1)} WHEN {n} > 3 AND suffix({token}, 'n') THEN {cut(1)} END",
        f"CASE WHEN {n} > 3 AND suffix({token}, 'e') THEN {cut(1)} END",
        f"CASE WHEN {n} > 4 AND suffix({token}, 'er') THEN {cut(2)} END",
        f"CASE WHEN {n} > 3 AND suffix({token}, 's') THEN {cut(1)} END",
        *[f"{token} || '{e}'" for e in ("n", "en", "e", "er", "s")],
    ]
    usable = f"list_filter([{', '.join(rules)}], lambda z: z IS NOT NULL AND length(z) >= 2 AND z <> {token})"
    ranked = f"list_sort(list_transform(list_distinct({usable}), lambda z: {{'n': length(z), 'v': z}}))[1:4]"
    return f"list_sort(list_distinct([{token}] || CASE {exact} {compound} ELSE list_transform({ranked}, lambda z: z.v) END))"


@query(
    "nrm20_token_forms",
    f"SELECT token, array_to_string({token_forms_sql('token')}, '|') AS forms FROM (SELECT DISTINCT token FROM (SELECT unnest(string_split({norm_sql('text')}, ' ')) AS token FROM documents) WHERE token <> '')",
)
def _(t: Tables):
    spoken = t.read("documents").select(F.explode(text.words(text.normalize_text(F.col("text")))).alias("token")).distinct()
    return spoken.select("token", F.array_join(tokens.token_forms(F.col("token")), "|").alias("forms"))


def _german_queries(t: Tables):
    """Search phrases: a German term, with the second half of them extended by a product name."""
    term = _pick(GERMAN_TERMS, "p_partkey")
    phrase = F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", term, "p_name")).otherwise(term)
    return t.read("part").select(phrase.alias("q")).distinct()


_GERMAN_SQL = f"SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN term || ' ' || p_name ELSE term END AS q FROM (SELECT *, {_pick_sql(GERMAN_TERMS, 'p_partkey')} AS term FROM part)"


def _umlaut_sql() -> str:
    options = []
    for plain, umlaut in tokens.UMLAUT_PAIRS:
        blocked = " OR ".join(f"contains(q, '{s}')" for s in tokens.NOT_UMLAUT.get(plain, [])) or "false"
        options.append(f"CASE WHEN contains(q, '{plain}') AND NOT ({blocked}) THEN {{'s': '{plain}', 'd': '{umlaut}'}} END")
        options.append(f"CASE WHEN contains(q, '{umlaut}') THEN {{'s': '{umlaut}', 'd': '{plain}'}} END")
    masks = "[[1],[2],[3],[4],[1,2],[1,3],[1,4],[2,3],[2,4],[3,4],[1,2,3],[1,2,4],[1,3,4],[2,3,4],[1,2,3,4]]"
    made = "q"
    for i in (1, 2, 3, 4):
        made = f"(CASE WHEN list_contains(m, {i}) THEN replace({made}, a[{i}].s, a[{i}].d) ELSE {made} END)"
    return f"""SELECT q, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i)[1:7], '|') AS variants FROM (
SELECT q, list_filter(list_transform(list_filter({masks}, lambda m: list_max(m) <= len(a)), lambda m: {made}), lambda x: x <> q) AS v FROM (
SELECT q, list_filter([{', '.join(options)}], lambda x: x IS NOT NULL)[1:4] AS a FROM ({_GERMAN_SQL})))"""


@query("nrm21_umlaut_variants", _umlaut_sql())
def _(t: Tables):
    return _german_queries(t).select("q", F.array_join(tokens.umlaut_variants(F.col("q")), "|").alias("variants"))


def _synonym_sql() -> str:
    phrases = []
    for pattern, long_form, short in tokens.PHRASE_SYNONYMS:
        phrases += [f"regexp_replace(q, '{pattern}', '{long_form}', 'g')", f"replace(q, '{long_form}', '{short}')"]
    swaps = [(a, b) for g in tokens.SYNONYM_GROUPS for a in g for b in g if a != b]
    widen = [(a, b) for a, wider in tokens.WIDER_TERMS for b in wider]

    def replaced(pairs: list[tuple[str, str]]) -> str:
        table = "[" + ", ".join(f"{{'a': '{a}', 'b': '{b}'}}" for a, b in pairs) + "]"
        return (
            f"flatten(list_transform(tk, lambda w, i: list_transform(list_filter({table}, lambda p: p.a = w), "
            f"lambda p: array_to_string(list_transform(tk, lambda x, j: CASE WHEN j = i THEN p.b ELSE x END), ' '))))"
        )

    spaced = [f"CASE WHEN contains(q, '{a}') THEN replace(q, '{a}', '{b}') END" for a, b in widen if " " in a]
    return f"""SELECT q, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') AS variants FROM (
SELECT q, list_filter([{', '.join(phrases)}] || {replaced(swaps)} || {replaced(widen)} || [{', '.join(spaced)}], lambda x: x IS NOT NULL AND x <> q) AS v
FROM (SELECT q, string_split(lower(q), ' ') AS tk FROM ({_GERMAN_SQL})))"""


@query("nrm22_synonym_variants", _synonym_sql())
def _(t: Tables):
    return _german_queries(t).select("q", F.array_join(tokens.synonym_variants(F.col("q")), "|").alias("variants"))


@query(
    "nrm23_abbreviation",
    "SELECT q, CASE " + " ".join(
        f"WHEN contains(' ' || q || ' ', ' {s} ') THEN trim(replace(' ' || q || ' ', ' {s} ', ' {f} '))" for s, f in tokens.ABBREVIATIONS
    ) + f" ELSE q END AS expanded FROM ({_GERMAN_SQL})",
)
def _(t: Tables):
    return _german_queries(t).select("q", tokens.expand_abbreviation(F.col("q")).alias("expanded"))


# --- filters ---------------------------------------------------------------------------------------------------------


@query("flt1_chain_list", "SELECT offer_id, chain, sales_price FROM offers WHERE chain IN ('Chain#1', 'Chain#4', 'Chain#7')")
def _(t: Tables):
    return t.offers.where(F.col("chain").isin("Chain#1", "Chain#4", "Chain#7")).select("offer_id", "chain", "sales_price")


@query(
    "flt3_substring_forms",
    f"SELECT offer_id FROM offers WHERE (contains(x, 'gear') OR contains(x, 'ring') OR contains(x, 'gizmo')) AND (contains(x, 'red') OR contains(x, 'old'))".replace(
        "FROM offers", f"FROM (SELECT offer_id, {norm_sql('product_name')} AS x FROM offers)"
    ),
)
def _(t: Tables):
    x = text.normalize_text(F.col("product_name"))
    forms = [["gear", "ring", "gizmo"], ["red", "old"]]
    keep = F.lit(True)
    for any_of in forms:
        keep = keep & F.exists(F.array(*[F.lit(f) for f in any_of]), lambda f: F.contains(x, f))
    return t.offers.where(keep).select("offer_id")


def _typo_sql(token: str) -> str:
    places = f"range(0, length({token}))"
    drop = f"list_filter(list_transform({places}, lambda i: substr({token}, 1, i) || substr({token}, i + 2)), lambda z: length(z) >= 2)"
    swap = f"list_transform({places}, lambda i: substr({token}, 1, i) || '_' || substr({token}, i + 2))"
    grow = f"list_transform(range(0, length({token}) + 1), lambda i: substr({token}, 1, i) || '_' || substr({token}, i + 1))"
    return f"CASE WHEN length({token}) < 3 THEN [{token}] ELSE {drop} || {swap} || {grow} END"


@query(
    "flt4_typo_patterns",
    f"""SELECT word, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') AS patterns
FROM (SELECT word, {_typo_sql('word')} AS v FROM ({_VOCABULARY_SQL}))""",
)
def _(t: Tables):
    return _vocabulary(t).select("word", F.array_join(tokens.typo_patterns(F.col("word")), "|").alias("patterns"))


@query(
    "flt5_brand_filter",
    "SELECT offer_id, brand FROM offers WHERE regexp_matches(brand, '(?i)\\bbrand#1\\b')",
)
def _(t: Tables):
    from offerloom.operators.matching import brand_matches

    return t.offers.where(brand_matches(F.lit("brand#1"), F.col("brand"))).select("offer_id", "brand")


@query("flt6_blocked_categories", "SELECT category_id, name FROM categories WHERE NOT (contains(lower(name), 'widget') OR contains(lower(name), 'sonstig'))")
def _(t: Tables):
    from offerloom.operators.categories import is_blocked

    return t.categories.where(~is_blocked(F.col("name"), ["widget"])).select("category_id", "name")


@query(
    "flt7_acceptance",
    "SELECT offer_id FROM (SELECT offer_id, (page_number * 11) % 77 AS score, CASE WHEN page_number <> 5 THEN sales_price END AS p FROM raw_offers) WHERE score >= CASE WHEN p IS NULL THEN 60 ELSE 55 END",
)
def _(t: Tables):
    from offerloom.operators.matching import accepted

    price = F.when(F.col("page_number") != 5, F.col("sales_price"))
    return t.raw_offers.where(accepted((F.col("page_number") * 11) % 77, price)).select("offer_id")


@query(
    "flt8_deal_intent",
    f"""SELECT q, CASE WHEN list_has_any(w, {_lit_list(tokens.DEAL_WORDS)}) THEN 1 ELSE 0 END AS deal,
 array_to_string(list_filter(w, lambda x: NOT list_contains({_lit_list(tokens.DEAL_WORDS)}, x)), ' ') AS rest FROM (SELECT q, string_split(lower(q), ' ') AS w FROM ({_GERMAN_SQL}))""",
)
def _(t: Tables):
    q = F.col("q")
    return _german_queries(t).select("q", tokens.asks_for_deals(q).cast("int").alias("deal"), tokens.without_deal_words(q).alias("rest"))
