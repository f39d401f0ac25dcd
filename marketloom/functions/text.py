"""Text rules as column expressions: names, prices, dates, plates and signals in Portuguese adverts.

Patterns are matched on folded text (lower case, no accents), so they need no flags and mean the
same in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical brand names by spelling.
BRANDS = {
    "vw": "Volkswagen",
    "v.w.": "Volkswagen",
    "volks wagen": "Volkswagen",
    "citroen": "Citroën",
    "citroën": "Citroën",
    "citröen": "Citroën",
    "mercedes": "Mercedes-Benz",
    "mercedes benz": "Mercedes-Benz",
    "mercedesbenz": "Mercedes-Benz",
    "skoda": "Skoda",
    "škoda": "Skoda",
    "renault": "Renault",
    "bmw": "BMW",
    "land-rover": "Land Rover",
    "landrover": "Land Rover",
    "alfa-romeo": "Alfa Romeo",
    "alfaromeo": "Alfa Romeo",
}

# Colours by spelling.
COLOURS = {
    "cinza": "cinzento",
    "cinzento escuro": "cinzento",
    "cinzento claro": "cinzento",
    "prata": "cinzento",
    "prateado": "cinzento",
    "silver": "cinzento",
    "gray": "cinzento",
    "grey": "cinzento",
    "white": "branco",
    "black": "preto",
    "red": "vermelho",
    "blue": "azul",
    "green": "verde",
    "yellow": "amarelo",
    "orange": "laranja",
    "brown": "castanho",
    "beige": "bege",
}

# Months.
MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]

# Phrases, on folded text.
PARTS_ONLY = r"para pecas|vender as pecas|venda de pecas|vende[- ]se a? ?pecas|para sucata|para desmanchar|so pecas|abate|para exporta(r|cao).{0,40}pecas|sem matricula|sem documentos"
NON_RUNNER = r"nao pega|nao anda|nao funciona|nao liga|nao arranca|nao (e )?possivel test(ar|a-lo)|non[ -]runner|engine seized|(so|apenas) (de |com )?reboque"
SEVERE = r"motor (fundido|avariad[oa])|caixa avariad[oa]|transmissao avariad[oa]|capotamento|junta (de cabeca )?queimada|avaria (no|do) motor"
PRISTINE = r"como novo|impecavel|excelente estado|estado excelente|perfeito estado|estado perfeito|irrepreensivel|estado de novo|\bfull extras\b"
URGENT = r"\burgente\b|preciso vender|vend[ao] rapido|emigracao|preco para despachar|motivo de viagem|vou emigrar|ultima semana|preciso do dinheiro|venda urgente|urgencia"
NEGOTIABLE = r"aceito propostas|negociavel|oportunidade|abaixo d[oe] mercado|preco fixo e justo|melhor oferta|faco bom preco"
NO_WARRANTY = r"sem garantia|nao (tem|inclui|oferec)\w* garantia"
WARRANTY = r"\bgarantia\b"
FLEET = r"\bex[ -]?taxi\b|\btaxi\b|\btvde\b|\buber\b|\bbolt\b|\bcabify\b|rent[ -]?a[ -]?car|\bfrota\b|carro de empresa|viatura de empresa|leasing terminado|fim de leasing|ex[ -]?aluguer"
# Tyre conditions and single owners, the first that holds, on unaccented text.
TYRES = [
    ("new", r"(4|quatro)?\s*pneus?\s+novos?"),
    ("new", r"pneus?\s+(acabad|recente)\w*\s+d[eo]\s+(trocar|colocar|montar)"),
    ("good", r"pneus?\s+(em\s+)?(bom|optimo|otimo|excelente)\s+estado"),
    ("good", r"(8|9)0\s*%\s*(de\s+)?piso"),
    ("good", r"pneus?\s+(bons?|recentes?)"),
    ("fair", r"pneus?\s+(em\s+)?estado\s+razoavel"),
    ("fair", r"(5|6)0\s*%\s*(de\s+)?piso"),
    ("poor", r"pneus?\s+(gast|desgastad)"),
    ("poor", r"precisa\s+d[eo]\s+pneus?"),
]
FIRST_OWNER = r"1\s*dono\s+(desde\s+novo|desde\s+0\s*km)|(unico|primeiro)\s+dono|comprad[oa]\s+nov[oa]\s+por\s+mim|\b1\s*dono\b|um\s+dono|sempre\s+o\s+mesmo\s+dono|unica\s+dona|um\s+registo"
# Modifications; of the first two the words themselves are kept.
REMAPPED, STAGE = r"reprogramacao\s*(stage\s*\d)?(\s*\w+)?", r"stage\s*[12]\b[^,.)]*"
TUNING = [
    ("remap", r"\bremap\b"),
    ("chip tuning", r"chip\s*tuning"),
    ("suspensão rebaixada", r"suspensao\s+rebaixada"),
    ("coilovers", r"\bcoilovers?\b"),
    ("escape desportivo", r"escape\s+desportivo(?!\s+original)"),
    ("downpipe", r"\bdownpipe\b"),
    ("wrap", r"\bwrap\b"),
    ("bodykit", r"\bbodykit\b"),
    ("bodykit", r"\bbody\s*kit\b"),
    ("turbo upgrade", r"turbo\s+upgrade"),
    ("intercooler upgrade", r"intercooler\s+(aftermarket|upgrade|maior)"),
    ("sem catalisador", r"sem\s+catalisador"),
    ("catalisador removido", r"catalisador\s+removido"),
    ("pop & bang", r"pop\s*&?\s*bang"),
    ("admissão desportiva", r"admissao\s+(desportiv|aftermarket|aberta)"),
]
SUSPENSION = r"\b(h&r|bilstein|eibach|tein)\b"
# Finished maintenance work.
MAINTENANCE = [
    ("correia distribuição", r"correia\s+d[eo]\s+distribuicao[\w\s,]*(troca|feita|nova|substituida|aos\s+\d+)"),
    ("kit distribuição", r"kit\s+distribuicao[\w\s,]*(troca|feita|nova|substituida|aos\s+\d+)"),
    ("embreagem nova", r"embreagem\s+(nova|trocada|substituida|feita)"),
    ("embreagem nova", r"embrai?agem\s+(nova|trocada|substituida|feita)"),
    ("travões", r"(trocou|trocad[oa]s?|novos?|novas?).{0,30}(travoes|pastilhas)"),
    ("pastilhas/discos travão", r"(pastilhas|discos)\s+d[eo]\s+travao\s+(novos?|novas?|trocad[oa]s?)"),
    ("bomba de água", r"bomba\s+d[eo]\s+agua\s+(nova|trocada)"),
    ("revisão", r"revisao\s+(feita|completa|geral|na\s+marca)"),
    ("óleo e filtros", r"oleo\s+(e\s+filtros?\s+)?(trocad|mudad|feita)"),
    ("filtros", r"filtros?\s+(trocad|novos?|mudad)"),
    ("amortecedores", r"amortecedores?\s+(novos?|trocad)"),
    ("molas", r"molas?\s+(novas?|trocad)"),
    ("bateria nova", r"bateria\s+(nova|trocada)"),
    ("pneus", r"pneus?\s+(novos?|trocad)"),
    ("bomba combustível", r"bomba\s+d[eo]\s+combustivel\s+(nova|trocada)"),
    ("juntas homocinéticas", r"juntas?\s+homo[\s-]?cineticas?\s+(novas?|trocad)"),
    ("volante do motor", r"volante\s+d[eo]\s+motor\s+(novo|trocado)"),
    ("turbo", r"turbo\s+(novo|recondicionado|trocad)"),
    ("injetores", r"injetores?\s+(novos?|recondicionad|trocad)"),
    ("bomba direção", r"bomba\s+d[eo]\s+direccao\s+(nova|trocada)"),
    ("radiador", r"radiador\s+(novo|trocad)"),
    ("alternador", r"alternador\s+(novo|trocad)"),
    ("motor de arranque", r"motor\s+d[eo]\s+arranque\s+(novo|trocad)"),
    ("valvulina caixa", r"valvulina\s+(trocada|nova|mudada)"),
]
MANY_PARTS, MANY_PARTS_LABEL = r"(pecas|material)\s+trocad\w*[\s:]*\n", "múltiplas peças trocadas (ver descrição)"


def unaccented(c: Column) -> Column:
    """Lower case without Portuguese accents; white space stays as it is."""
    return F.translate(F.lower(c), "áàãâéêíóôõúç", "aaaaeeiooouc")


def _holds(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(unaccented(c), F.lit(pattern)), F.lit(False))


def folded(c: Column) -> Column:
    """Lower case without accents, runs of white space as one blank."""
    plain = F.translate(F.lower(c), "áàãâäéêèëíìïóôõòöúùüçñ", "aaaaaeeeeiiiooooouuucn")
    return F.regexp_replace(plain, r"\s+", " ")


def says(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(folded(c), F.lit(pattern)), F.lit(False))


def _lookup(c: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, F.lower(F.trim(c)))


def canonical_brand(c: Column) -> Column:
    """Unknown names pass trimmed; null becomes empty."""
    return F.coalesce(_lookup(c, BRANDS), F.trim(c), F.lit(""))


def zone_of(district: Column, zones: dict[str, str]) -> Column:
    """The zone of a district by a fixed map, whatever its case and accents; null for unknown ones."""
    if not zones:
        return F.lit(None).cast("string")
    plain = str.maketrans("áàãâäéêèëíìïóôõòöúùüçñ", "aaaaaeeeeiiiooooouuucn")
    pairs = F.create_map(*[F.lit(v) for name, zone in zones.items() for v in (name.lower().translate(plain), zone)])
    return F.try_element_at(pairs, F.trim(folded(district)))


def canonical_colour(c: Column) -> Column:
    low = F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.coalesce(_lookup(c, COLOURS), low)


def slug_part(url: Column, k: int) -> Column:
    """The k-th segment of a url's path, from 1; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"^[a-z]+://[^/?#]*" + r"/[^/?#]*" * (k - 1) + r"/([^/?#]+)", 1), F.lit(""))


def last_number(url: Column) -> Column:
    """The number that ends a url's path, as an id."""
    return F.nullif(F.regexp_extract(url, r"/(\d+)(?:\.html)?/?(?:[?#].*)?$", 1), F.lit(""))


def advert_id(url: Column) -> Column:
    """The id in a url that ends in ID<id>.html."""
    return F.nullif(F.regexp_extract(url, r"ID(\w+)\.html", 1), F.lit(""))


def price_eur(c: Column) -> Column:
    """EUR text to double; null if there is no number.

    Only what precedes the first letter counts, and of it digits, dots and commas. A comma is the
    decimal sign, dots before it separate thousands; without a comma, dots do so if three digits
    follow the last one.
    """
    number = F.regexp_replace(F.regexp_extract(c, r"^([^a-zA-Zà-ÿ]*)", 1), r"[^\d,.]", "")
    plain = F.when(number.contains(","), F.replace(F.replace(number, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    plain = plain.when(F.regexp_like(number, F.lit(r"\.[^.]{3}$")), F.replace(number, F.lit("."), F.lit(""))).otherwise(number)
    return plain.try_cast("double")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "").try_cast("long")


def lenient_double(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^0-9,.\-]", ""), ",", ".").try_cast("double")


def fixed_mileage(km: Column, year: Column, this_year: int) -> Column:
    """Times 1000 where a mileage below 1000 lacks its thousands: without a year, below 500 a year, or where
    the larger one gives 3,000 to 40,000 a year."""
    age = F.greatest(F.lit(this_year) - year, F.lit(1))
    lacks = year.isNull() | (km / age < 500) | (km * 1000 / age).between(3000, 40000)
    return F.when((km != 0) & (km < 1000) & lacks, km * 1000).otherwise(km)


def month_number(c: Column) -> Column:
    plain = [m.replace("ç", "c") for m in MONTHS]
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in plain]), folded(c)), F.lit(0)).cast("int")


def portuguese_date(c: Column) -> Column:
    """'12 de março de 2024 às 10:30' to a timestamp; null if it is none. The time is any hh:mm of the text, midnight without one."""
    t = folded(c)
    part = lambda i: F.regexp_extract(t, r"(\d{1,2})\s+de\s+(\w+)\s+de\s+(\d{4})", i)
    number = lambda x: F.coalesce(x.try_cast("int"), F.lit(0))
    time = lambda i: number(F.regexp_extract(t, r"(\d{1,2}):(\d{2})", i))
    return F.try_make_timestamp(number(part(3)), month_number(part(2)), number(part(1)), time(1), time(2), F.lit(0))


def member_since(c: Column) -> Column:
    """'desde março de 2020' to the first of that month."""
    t = folded(c)
    year, month = F.regexp_extract(t, r"([a-z]+) de (\d{4})", 2), F.regexp_extract(t, r"([a-z]+) de (\d{4})", 1)
    return F.to_date(F.try_make_timestamp(year.try_cast("int"), month_number(month), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def plates(c: Column) -> Column:
    """Plates of the five valid layouts of three pairs (D digits, L letters), as AA-00-AA.

    Other signs than separators are taken out first; what is left is read from the left, so signs
    within a longer run of letters and digits are no plate.
    """
    kept = F.upper(F.regexp_replace(c, r"[^A-Za-z0-9\s\-.·_]", ""))
    raw = F.regexp_extract_all(kept, F.lit(r"(?<![A-Z0-9])([A-Z0-9]{2}[\s\-.·_]?[A-Z0-9]{2}[\s\-.·_]?[A-Z0-9]{2})(?![A-Z0-9])"), 1)
    dashed = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(x, r"[\s\-.·_]", ""), "^(..)(..)(..)$", "$1-$2-$3"))
    layouts = r"^(\d\d-\d\d-\d\d|\d\d-\d\d-[A-Z]{2}|[A-Z]{2}-\d\d-\d\d|\d\d-[A-Z]{2}-\d\d|[A-Z]{2}-\d\d-[A-Z]{2})$"
    return F.filter(dashed, lambda x: F.regexp_like(x, F.lit(layouts)))


def urgency(c: Column) -> Column:
    return F.when(says(c, URGENT), "high").when(says(c, NEGOTIABLE), "medium").otherwise("low")


def warranty(c: Column) -> Column:
    return F.when(says(c, NO_WARRANTY), False).when(says(c, WARRANTY), True)


def fleet(c: Column) -> Column:
    return F.when(says(c, FLEET), True)


def tyres(c: Column) -> Column:
    """new, good, fair, poor or null."""
    return F.coalesce(*[F.when(_holds(c, p), state) for state, p in TYRES])


def first_owner(c: Column) -> Column:
    return F.when(_holds(c, FIRST_OWNER), True)


def tuning(c: Column) -> Column:
    """Modifications as an array of labels, in the order of the rules; null text has none."""
    t = unaccented(F.coalesce(c, F.lit("")))
    found = lambda p: F.nullif(F.trim(F.regexp_extract(t, p, 0)), F.lit(""))
    remapped, stage = found(REMAPPED), found(STAGE)
    # a stage that the first words already name is not told twice
    told = F.coalesce(remapped.contains(stage) | stage.contains(remapped), F.lit(False))
    marks = [remapped, F.when(~told, stage), *[F.when(_holds(c, p), label) for label, p in TUNING]]
    kw = F.when(_holds(c, r"\bkw\b(?!\s*h\b)(?!\s*\d)") & ~_holds(c, r"\d+\s*kw\b"), F.array(F.lit("kw"))).otherwise(F.array())
    brands = F.transform(F.concat(F.regexp_extract_all(t, F.lit(SUSPENSION), 1), kw), lambda b: F.concat(F.lit("suspensão "), F.upper(b)))
    return F.array_distinct(F.concat(F.array_compact(F.array(*marks)), brands))


def maintenance(c: Column) -> Column:
    """Finished work as an array of labels, with the km told within 40 characters; null text has none."""
    t = unaccented(F.coalesce(c, F.lit("")))

    def label(name: str, pattern: str) -> Column:
        start, n = F.regexp_instr(t, F.lit(pattern)), F.length(F.regexp_extract(t, pattern, 0))
        before = F.greatest(start - 40, F.lit(1))
        km = F.replace(F.regexp_extract(F.substring(t, before, start + n + 40 - before), r"(\d[\d.]*)\s*km", 1), F.lit("."), F.lit(""))
        return F.when(start > 0, F.when(km == "", name).otherwise(F.concat(F.lit(f"{name} ("), km, F.lit("km)"))))

    by_name: dict[str, list[Column]] = {}
    for name, pattern in MAINTENANCE:
        by_name.setdefault(name, []).append(label(name, pattern))
    found = F.array_compact(F.array(*[F.coalesce(*x) for x in by_name.values()]))
    return F.when((F.size(found) == 0) & F.regexp_like(t, F.lit(MANY_PARTS)), F.array(F.lit(MANY_PARTS_LABEL))).otherwise(found)


def damage_severity(text: Column, condition: Column, accident: Column, repair: Column, guaranteed: Column) -> Column:
    """0 (as new) to 3 (parts only, not running); the first rule that holds."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    poor = yes(condition == "poor")
    return (
        F.when(says(text, PARTS_ONLY) | says(text, NON_RUNNER), 3)
        .when(says(text, SEVERE), F.when(poor, 3).otherwise(2))
        .when(yes(accident) | yes(repair) | poor, 2)
        .when(yes(condition == "excellent") | says(text, PRISTINE) | yes(guaranteed), 0)
        .otherwise(1)
    )


def salvage_phrase(c: Column) -> Column:
    return F.nullif(F.regexp_extract(folded(c), f"({PARTS_ONLY}|{SEVERE}|{NON_RUNNER})", 1), F.lit(""))


def numbers_out(c: Column) -> Column:
    return F.regexp_replace(c, r"\d+(\.\d+)?", "N")


def tidy(text: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("")), title)


def brand_in_title(title: Column, brands: list[str]) -> Column:
    """The longest known brand that stands in the title as whole words."""
    import re

    names = "|".join(re.escape(b.lower()) for b in sorted(brands, key=lambda b: (-len(b), b)))
    return F.nullif(F.regexp_extract(F.lower(title), rf"(?:^|[^\w])({names})(?:$|[^\w])", 1), F.lit(""))


# Families of makers, and of the engine names that they alone use.
BRAND_FAMILIES = {
    "VAG": ["Volkswagen", "VW", "Audi", "Seat", "SEAT", "Skoda", "Škoda"],
    "PSA": ["Peugeot", "Citroen", "Citroën", "DS"],
    "MB": ["Mercedes-Benz", "Mercedes"],
    "RNO": ["Renault", "Dacia", "Nissan"],
    "FCA": ["Fiat", "Alfa Romeo", "Lancia", "Jeep"],
    "FORD": ["Ford"],
    "HK": ["Hyundai", "Kia"],
    "MAZDA": ["Mazda"],
    "BMW": ["BMW", "Mini", "MINI"],
}
ENGINE_FAMILIES = {
    "VAG": ["tdi", "tfsi", "tsi"],
    "PSA": ["hdi", "bluehdi", "puretech", "ehdi"],
    "MB": ["cdi", "bluetec"],
    "RNO": ["dci", "tce", "bluedci", "digt"],
    "FCA": ["multijet", "mjet", "jtd"],
    "FORD": ["tdci", "ecoboost"],
    "HK": ["crdi"],
    "MAZDA": ["skyactived"],
    "GM": ["cdti"],
}
ENGINE_NAME = r"(?i)\b(BlueHDi|BlueTec|Blue\s+dCi|Blue\s+HDi|PureTech|EcoBoost|Multijet|M-?Jet|SkyActive-?D|DIG-?T|TDI|TFSI|TSI|HDI|CDTI|CDI|dCi|TCe|TDCi|JTD|CRDi|e-HDi)\b"


def fitting_sub_model(brand: Column, sub_model: Column) -> Column:
    """The sub-model, or null where it names an engine of another maker's family; unknown makers and names pass."""
    table = lambda families: F.create_map(*[F.lit(x) for family, names in families.items() for n in names for x in (n, family)])
    maker = F.try_element_at(table(BRAND_FAMILIES), brand)
    engine = F.try_element_at(table(ENGINE_FAMILIES), F.regexp_replace(F.lower(F.regexp_extract(sub_model, ENGINE_NAME, 1)), r"[\s\-]", ""))
    return F.when(~F.coalesce(maker != engine, F.lit(False)), sub_model)


# Features told as whole numbers.
WHOLE_FEATURES = ["year", "engine_cc", "horsepower", "photo_count", "description_length", "seats", "doors", "seller_listings_count_90d"]


def contribution_label(feature: Column, value: Column) -> Column:
    """'year=2018', 'mileage=85k', 'plate_obscured=yes', 'generation=C7'; a dash where the value (text) is unknown."""
    number = value.try_cast("double")
    whole = F.format_string("%d", F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
    told = (
        F.when((feature == "mileage_km") & number.isNotNull(), F.concat(F.lit("mileage="), F.format_string("%d", F.bround(number / 1000, 0).cast("long")), F.lit("k")))
        .when(feature.isin(*WHOLE_FEATURES) & number.isNotNull(), F.concat(feature, F.lit("="), whole))
        .when((feature == "plate_obscured") & number.isNotNull(), F.concat(feature, F.lit("="), F.when(F.abs(number) >= 1, "yes").otherwise("no")))
        .when(value.rlike(r"^-?\d+\.\d+$"), F.concat(feature, F.lit("="), F.format_string("%.2f", number)))
    )
    return F.coalesce(told, F.concat(feature, F.lit("="), F.coalesce(value, F.lit("—"))))


# The words of an alert.
DEAL_WORDS = {
    "accident": "упоминание ДТП",
    "repair": "упоминание ремонта",
    "customs": "нет упоминания о растаможке",
    "owners": "упоминание: %d владельцев",
    "described": "📝 Из описания: ",
    "pseudo": "псевдочастник (Utilizador, но JSON=Empresa)",
    "parts": "продаёт запчасти (%d)",
    "brands": "%d разных марок под Particular",
    "seller": "👤 Продавец: ",
    "photo": "фото профиля",
    "age": "акк %d+ лет",
    "trust": "✓ Доверие: ",
}


def deal_message(columns: list[str]) -> Column:
    """The text of an alert, from the columns of a deal; those that are not in ``columns`` count as null.

    Fire by the discount (over 25, over 20), car, price and median, mileage and place, what the
    description mentions, what speaks against and for the seller, the photo score (also from the JSON extras), the link.
    """
    c = lambda name: F.col(name) if name in columns else F.lit(None)
    number = lambda name: F.nullif(F.nanvl(c(name).cast("double"), F.lit(0.0)), F.lit(0.0))
    said = lambda name: F.coalesce(F.nullif(c(name).cast("string"), F.lit("")), F.lit(""))
    true = lambda name: F.coalesce(c(name).cast("boolean"), F.lit(False))
    whole = lambda name: F.coalesce(number(name), F.lit(0.0)).cast("long")
    thousands = lambda name: F.format_number(whole(name), 0)
    known = lambda name: F.coalesce(c(name).cast("string"), F.lit("?"))
    two = lambda x: F.format_string("%.2f", F.bround(x, 2))
    w = {k: F.lit(v) for k, v in DEAL_WORDS.items()}
    counted = lambda name, key: F.format_string(DEAL_WORDS[key], whole(name))
    discount = F.coalesce(c("discount_pct").cast("double"), F.lit(0.0))
    fire = F.when(discount > 25, "🔥🔥🔥").when(discount > 20, "🔥🔥").otherwise("🔥")
    generation = F.when(said("generation") != "", F.concat(F.lit(" ("), said("generation"), F.lit(")"))).otherwise("")
    place = F.when(said("city") != "", F.concat(said("city"), F.lit(", "), said("district"))).otherwise(said("district"))
    score, sure = c("flipper_score").cast("double"), c("flipper_confidence").cast("double")
    private = ~true("seller_is_business")
    described = [F.when(true("desc_mentions_accident"), w["accident"]), F.when(true("desc_mentions_repair"), w["repair"]), F.when(~c("desc_mentions_customs_cleared").cast("boolean"), w["customs"])]
    described += [F.when(number("desc_mentions_num_owners") >= 3, counted("desc_mentions_num_owners", "owners"))]
    against = [F.when(true("seller_pseudoprivate"), w["pseudo"]), F.when((number("seller_parts_count") > 0) & private, counted("seller_parts_count", "parts"))]
    against += [F.when((whole("seller_distinct_car_brands") >= 3) & private, counted("seller_distinct_car_brands", "brands"))]
    flipper = F.concat(F.when(score >= 0.75, "🚨").otherwise("⚠️"), F.lit(" flipper-score "), two(score), F.lit(" (conf "), F.bround(sure * 100, 0).cast("long").cast("string"), F.lit("%)"))
    against += [F.when((sure >= 0.4) & (score >= 0.5), flipper)]
    fitting = [F.when(said("seller_social_account_type") != "", F.concat(said("seller_social_account_type"), F.lit(" link"))), F.when(true("seller_has_user_photo"), w["photo"])]
    fitting += [F.when(whole("seller_account_age_days") >= 365 * 7, F.format_string(DEAL_WORDS["age"], F.floor(whole("seller_account_age_days") / 365)))]
    photo = F.coalesce(c("photo_damage_p").cast("double"), F.get_json_object(c("llm_extras").cast("string"), "$.photo_damage_p").try_cast("double"))
    some = lambda title, parts: F.when(F.size(F.array_compact(F.array(*parts))) > 0, F.concat(w[title], F.array_join(F.array_compact(F.array(*parts)), ", ")))
    return F.concat_ws(
        "\n",
        F.concat(fire, F.lit(" <b>"), known("brand"), F.lit(" "), known("model"), F.lit(" "), known("year"), F.lit("</b>"), generation),
        F.concat(F.lit("💰 <b>"), thousands("price_eur"), F.lit(" EUR</b> (median "), thousands("median_price_eur"), F.lit(" EUR)")),
        F.concat(F.lit("📉 <b>-"), F.coalesce(c("discount_pct").cast("string"), F.lit("0")), F.lit("%</b> below market")),
        F.when(number("mileage_km").isNotNull(), F.concat(F.lit("🛣 "), thousands("mileage_km"), F.lit(" km"))),
        F.when(place != "", F.concat(F.lit("📍 "), place)),
        some("described", described),
        some("seller", against),
        some("trust", fitting),
        F.when(photo >= 0.10, F.concat(F.lit("📷 Photo classifier: p_damaged="), two(photo))),
        F.when(said("url") != "", F.concat(F.lit('\n<a href="'), said("url"), F.lit('">Open on OLX</a>'))),
    )


# What a page says whose advert is gone.
DEAD_MARKERS = [
    "anúncio que tentas aceder não existe ou foi eliminado",
    "anúncio que pretende aceder não existe",
    "this advert no longer exists",
    "página que estás à procura não existe",
    "página não encontrada",
    "anúncio não disponível",
    "anúncio que procuras não está disponível",
]


def page_is_dead(status: Column, body: Column) -> Column:
    """True for 404 and 410, and for a 200 whose page says that the advert is gone; false for any other 200; null if that is not known."""
    gone = F.lit(False)
    for mark in DEAD_MARKERS:
        gone = gone | F.coalesce(F.lower(body).contains(mark), F.lit(False))
    return F.when(status.isin(404, 410), True).when(status == 200, gone)
