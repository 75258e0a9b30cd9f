"""SQL counterparts of the unit-price expressions, used only to check results."""

from __future__ import annotations

from offerloom.functions.units import PRICE_FORMS, QUANTITY_FORMS, UNIT_SPELLINGS, UNITS


def number_case_sql(gs: str) -> str:
    return (
        f"try_cast(CASE WHEN {gs} LIKE '%,%' AND {gs} LIKE '%.%' THEN replace(replace({gs}, '.', ''), ',', '.') "
        f"WHEN {gs} LIKE '%,%' THEN replace({gs}, ',', '.') "
        f"WHEN regexp_full_match({gs}, '[^.]*\\.[^.]{{3}}') THEN replace({gs}, '.', '') ELSE {gs} END AS DOUBLE)"
    )


def number_sql(text: str) -> str:
    return number_case_sql(f"regexp_replace(trim({text}), '(\\d+)\\.-?$', '\\1')")


def unit_key_sql(raw: str) -> str:
    token = f"lower(regexp_replace(trim({raw}), '\\.+$', ''))"
    for spelled, plain in UNIT_SPELLINGS.items():
        token = f"replace({token}, '{spelled}', '{plain}')"
    known = ", ".join(f"'{u}'" for u in UNITS)
    return f"(CASE WHEN {token} IN ({known}) THEN {token} END)"


def unit_attribute_sql(key: str, position: int) -> str:
    def lit(v: object) -> str:
        return f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"

    cases = " ".join(f"WHEN '{k}' THEN {lit(v[position])}" for k, v in UNITS.items())
    return f"(CASE {key} {cases} END)"


def base_price_struct_sql(text: str) -> str:
    """Struct (qty, unit, price, price_max) of strings for the first usable form."""
    t = f"trim(coalesce({text}, ''))"
    forms = []
    for form in PRICE_FORMS:
        pattern = "(?i)" + form.pattern

        def group(n: int) -> str:
            return f"regexp_extract({t}, '{pattern}', {n})" if n else "''"

        ok = f"{group(form.unit)} <> '' AND {unit_key_sql(group(form.unit))} IS NOT NULL AND {number_sql(group(form.price))} IS NOT NULL"
        if form.qty:
            ok += f" AND ({group(form.qty)} = '' OR {number_sql(group(form.qty))} > 0)"
        forms.append(
            f"WHEN {ok} THEN {{'qty': {group(form.qty)}, 'unit': {group(form.unit)}, 'price': {group(form.price)}, "
            f"'price_max': {group(form.price_max)}}}"
        )
    return f"(CASE {' '.join(forms)} END)"


def base_price_select_sql(text: str, source: str, carry: str = "*") -> str:
    """SELECT carrying the source columns plus quantity, unit, group, price, price_max and unit price."""
    inner = f"SELECT {carry}, {base_price_struct_sql(text)} AS bp FROM {source}"
    unit = unit_key_sql("bp.unit")
    mid = (
        f"SELECT * EXCLUDE (bp), CASE WHEN bp IS NULL THEN NULL WHEN bp.qty = '' THEN 1::DOUBLE ELSE {number_sql('bp.qty')} END AS quantity, "
        f"{unit} AS unit, {number_sql('bp.price')} AS price, {number_sql('bp.price_max')} AS price_max FROM ({inner})"
    )
    return (
        f"SELECT *, {unit_attribute_sql('unit', 0)} AS unit_group, {unit_attribute_sql('unit', 2)} AS normalized_unit, "
        f"price / (quantity * {unit_attribute_sql('unit', 1)}) AS ppn FROM ({mid})"
    )


def quantity_struct_sql(text: str) -> str:
    """Struct (quantity, unit) of the first usable quantity in a description."""
    parts = []
    for pattern, qty_group, unit_group in QUANTITY_FORMS:
        units = f"regexp_extract_all(coalesce({text}, ''), '(?i){pattern}', {unit_group})"
        qtys = f"regexp_extract_all(coalesce({text}, ''), '(?i){pattern}', {qty_group})" if qty_group else f"list_transform({units}, lambda z: '1')"
        pairs = f"list_transform(list_zip({qtys}, {units}), lambda p: {{'quantity': {number_sql('p[1]')}, 'unit': {unit_key_sql('p[2]')}}})"
        parts.append(f"list_filter({pairs}, lambda p: p.quantity > 0 AND p.unit IS NOT NULL)[1]")
    return f"coalesce({', '.join(parts)})"
