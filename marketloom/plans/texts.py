"""Queries of text rules, JSON and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions import text as x
from ..operators.enrich import with_zone
from .registry import Tables, query

#: Phrases that the driver's invented prose lacks; each row of ``part`` gets one after its name.
PHRASES = [
    "carro urgente, preciso vender",
    "Aceito propostas, garantia de 12 meses",
    "para peças, não pega",
    "motor fundido mas bonito",
    "Como NOVO, impecável",
    "ex-táxi, pneus novos",
    "sem garantia, pneus gastos",
    "um dono, revisão feita, bateria nova",
    "stage remap com downpipe",
    "vendido em 12 de Março de 2024 às 10:30",
    "desde fevereiro de 2020",
    "12.500 € negociável",
    "matrícula AA-12-BB",
    "reprogramação stage 1, stage 2 e coilovers, body kit",
    "stage 2 com suspensão KW e Bilstein",
    "150 kW, escape desportivo original, pneus desgastados",
    "correia de distribuição feita aos 120.000 km, embraiagem nova",
    "peças trocadas:\nvárias, único dono",
    "4 pneus novos, óleo e filtros trocados, pop & bang",
    "pneus em bom estado, comprado novo por mim",
    "50% de piso, sempre o mesmo dono, downpipe, travões: trocadas as pastilhas",
]
FOLD = "regexp_replace(translate(lower({0}), 'áàãâäéêèëíìïóôõòöúùüçñ', 'aaaaaeeeeiiiooooouuucn'), '\\s+', ' ', 'g')"
SPOKEN_SQL = "spoken AS (SELECT p_partkey AS id, p_size AS size, p_name || ' ' || CASE p_partkey % 21 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PHRASES)) + " END AS text, " "CASE p_partkey % 5 WHEN 0 THEN 'poor' WHEN 1 THEN 'excellent' END AS condition, CASE WHEN p_partkey % 7 = 0 THEN true END AS accident FROM part)"


def spoken(t: Tables) -> DataFrame:
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("p_partkey") % 21).cast("int"))
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("id"), F.col("p_size").alias("size"), F.concat_ws(" ", "p_name", phrase).alias("text"), F.when(k % 5 == 0, "poor").when(k % 5 == 1, "excellent").alias("condition"), F.when(k % 7 == 0, True).alias("accident")
    )


def folded_sql(select: str) -> str:
    return f"WITH {SPOKEN_SQL}, f AS (SELECT *, {FOLD.format('text')} AS t FROM spoken) SELECT id, {select} FROM f"


def matches(pattern: str) -> str:
    return f"regexp_matches(t, '{pattern}')"


def text_query(name: str, select: str, column):
    @query(name, folded_sql(select))
    def _(t: Tables) -> DataFrame:
        alias, made = column()
        return spoken(t).select("id", made.alias(alias))


text_query("x03_folded", "t AS folded", lambda: ("folded", x.folded(F.col("text"))))
text_query("x14_urgency", f"CASE WHEN {matches(x.URGENT)} THEN 'high' WHEN {matches(x.NEGOTIABLE)} THEN 'medium' ELSE 'low' END AS urgency", lambda: ("urgency", x.urgency(F.col("text"))))
text_query("x15_warranty", f"CASE WHEN {matches(x.NO_WARRANTY)} THEN false WHEN {matches(x.WARRANTY)} THEN true END AS warranty", lambda: ("warranty", x.warranty(F.col("text"))))
text_query("x17_fleet", f"CASE WHEN {matches(x.FLEET)} THEN true END AS fleet", lambda: ("fleet", x.fleet(F.col("text"))))
UNACCENTED = "translate(lower({0}), 'áàãâéêíóôõúç', 'aaaaeeiooouc')"


def unaccented_sql(select: str, more: str = "") -> str:
    return f"WITH {SPOKEN_SQL}, u AS (SELECT id, {UNACCENTED.format('text')} AS u FROM spoken){more} SELECT id, {select} FROM u"


@query(
    "x19_tyres",
    unaccented_sql(
        """CASE WHEN regexp_matches(u, 'pneus? +novos?|pneus? +(acabad|recente)[a-z]* +d[eo] +(trocar|colocar|montar)') THEN 'new'
    WHEN regexp_matches(u, 'pneus? +(em +)?(bom|optimo|otimo|excelente) +estado|[89]0 *% *(de +)?piso|pneus? +(bons?|recentes?)') THEN 'good'
    WHEN regexp_matches(u, 'pneus? +(em +)?estado +razoavel|[56]0 *% *(de +)?piso') THEN 'fair' WHEN regexp_matches(u, 'pneus? +(gast|desgastad)|precisa +d[eo] +pneus?') THEN 'poor' END AS tyres"""
    ),
)
def _(t: Tables) -> DataFrame:
    return spoken(t).select("id", x.tyres(F.col("text")).alias("tyres"))


@query("x19_first_owner", unaccented_sql("CASE WHEN regexp_matches(u, '(^|[^0-9a-z])1 *dono([^a-z]|$)|1 *dono +desde +(novo|0 *km)|(unico|primeiro|um|mesmo) +dono|comprad[oa] +nov[oa] +por +mim|unica +dona|um +registo') THEN true END AS first_owner"))
def _(t: Tables) -> DataFrame:
    return spoken(t).select("id", x.first_owner(F.col("text")).alias("first_owner"))


SEVERITY_SQL = f"""CAST(CASE WHEN {matches(x.PARTS_ONLY)} OR {matches(x.NON_RUNNER)} THEN 3 WHEN {matches(x.SEVERE)} THEN CASE WHEN coalesce(condition = 'poor', false) THEN 3 ELSE 2 END
  WHEN coalesce(accident, false) OR coalesce(condition = 'poor', false) THEN 2 WHEN coalesce(condition = 'excellent', false) OR {matches(x.PRISTINE)} THEN 0 ELSE 1 END AS INT)"""


def severity():
    none = F.lit(None).cast("boolean")
    return x.damage_severity(F.col("text"), F.col("condition"), F.col("accident"), none, none)


text_query("x20_damage_severity", f"{SEVERITY_SQL} AS severity", lambda: ("severity", severity()))
text_query("x21_salvage_phrase", f"nullif(regexp_extract(t, '({x.PARTS_ONLY}|{x.SEVERE}|{x.NON_RUNNER})', 1), '') AS phrase", lambda: ("phrase", x.salvage_phrase(F.col("text"))))
text_query("x23_numbers_out", "regexp_replace(text, '\\d+(\\.\\d+)?', 'N', 'g') AS reason", lambda: ("reason", x.numbers_out(F.col("text"))))
text_query("x26_tidy", "coalesce(nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), ''), 'x') AS tidy", lambda: ("tidy", x.tidy(F.col("text"), F.lit("x"))))
MONTH_NAMES = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]


def _month_of(k: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MONTH_NAMES]), (k - 1).cast("int"))


@query(
    "x10_portuguese_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN date_trunc('day', o_orderdate::TIMESTAMP) + CASE WHEN o_orderkey % 2 = 0 THEN to_hours(CAST(o_orderkey % 24 AS INT)) + to_minutes(CAST(o_orderkey % 60 AS INT)) ELSE INTERVAL 0 DAY END END AS at FROM orders""",
)
def _(t: Tables) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    written = F.concat(F.lit("Publicado "), F.dayofmonth(day).cast("string"), F.lit(" De "), F.when(k % 4 == 0, F.upper(_month_of(F.month(day)))).otherwise(_month_of(F.month(day))), F.lit(" de "), F.year(day).cast("string"))
    time = F.format_string("%d:%02d", k % 24, k % 60)
    # the time stands after "às", after a comma, or before the date
    timed = F.when(k % 3 == 0, F.concat(written, F.lit(" às "), time)).when(k % 3 == 1, F.concat(written, F.lit(", "), time)).otherwise(F.concat(time, F.lit("h - "), written))
    written = F.when(k % 2 == 0, timed).otherwise(written)
    return t.orders.select("o_orderkey", x.portuguese_date(F.when(k % 9 > 0, written).otherwise("31 de fevereiro de 2020")).alias("at"))


@query("x11_member_since", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS since FROM orders")
def _(t: Tables) -> DataFrame:
    day = F.col("o_orderdate")
    written = F.concat(F.lit("Membro desde "), _month_of(F.month(day)), F.lit(" de "), F.year(day).cast("string"))
    return t.orders.select("o_orderkey", x.member_since(F.when(F.col("o_orderkey") % 9 > 0, written).otherwise("desde ontem")).alias("since"))


@query(
    "x13_plates",
    """WITH d AS (SELECT p_partkey AS id, lpad((p_partkey % 100)::VARCHAR, 2, '0') AS a, lpad((p_partkey % 89)::VARCHAR, 2, '0') AS b, chr(CAST(65 + p_partkey % 26 AS INT)) || chr(CAST(65 + p_size % 26 AS INT)) AS l FROM part)
    SELECT id, CASE id % 6 WHEN 0 THEN l || '-' || a || '-' || b WHEN 1 THEN a || '-' || b || '-' || l WHEN 2 THEN a || '-' || l || '-' || b || ',' || l || '-' || a || '-' || l WHEN 3 THEN a || '-' || b || '-' || a ELSE '' END AS plates FROM d""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    a, b = F.lpad((k % 100).cast("string"), 2, "0"), F.lpad((k % 89).cast("string"), 2, "0")
    letters = F.concat(F.char(65 + k % 26), F.char(65 + F.col("p_size") % 26))
    low = F.lower(letters)
    said = (
        F.when(k % 6 == 0, F.concat(F.lit("matrícula "), low, F.lit("-"), a, F.lit(" "), b, F.lit(".")))
        .when(k % 6 == 1, F.concat(a, b, letters))
        .when(k % 6 == 2, F.concat(a, F.lit("."), letters, F.lit("."), b, F.lit(" e "), letters, a, letters))
        .when(k % 6 == 3, F.concat(a, F.lit("-"), b, F.lit("-"), a))
        .when(k % 6 == 4, F.concat(letters, F.lit("-"), letters, F.lit("-"), letters))
        .otherwise(F.concat(F.lit("x"), letters, a, b))
    )
    return t.part.select(k.alias("id"), F.concat_ws(",", x.plates(said)).alias("plates"))


TUNING_SQL = [
    ("remap", r"\bremap\b"),
    ("chip tuning", r"chip\s*tuning"),
    ("suspensão rebaixada", r"suspensao\s+rebaixada"),
    ("coilovers", r"\bcoilovers?\b"),
    ("downpipe", r"\bdownpipe\b"),
    ("wrap", r"\bwrap\b"),
    ("bodykit", r"\bbody\s*kit\b"),
    ("turbo upgrade", r"turbo\s+upgrade"),
    ("intercooler upgrade", r"intercooler\s+(aftermarket|upgrade|maior)"),
    ("sem catalisador", r"sem\s+catalisador"),
    ("catalisador removido", r"catalisador\s+removido"),
    ("pop & bang", r"pop\s*&?\s*bang"),
    ("admissão desportiva", r"admissao\s+(desportiv|aftermarket|aberta)"),
]
_marks = [f"CASE WHEN regexp_matches(u, '{p}') THEN '{label}' END" for label, p in TUNING_SQL]
# RE2 has no lookahead: factory exhausts and power in kW are taken out first
_marks.insert(4, "CASE WHEN regexp_matches(regexp_replace(u, 'escape\\s+desportivo\\s+original', '', 'g'), 'escape\\s+desportivo') THEN 'escape desportivo' END")


@query(
    "x16_tuning",
    unaccented_sql(
        f"""concat_ws(',', nullif(m0, ''), CASE WHEN m1 <> '' AND NOT (m0 <> '' AND (contains(m0, m1) OR contains(m1, m0))) THEN m1 END, {", ".join(_marks)},
    nullif(array_to_string(list_transform(regexp_extract_all(u, '\\b(h&r|bilstein|eibach|tein)\\b', 1), lambda b: 'suspensão ' || upper(b)), ','), ''),
    CASE WHEN regexp_matches(u, '\\bkw\\b') AND NOT regexp_matches(u, '\\d\\s*kw\\b|\\bkw\\s*(h\\b|\\d)') THEN 'suspensão KW' END) AS tuning"""
    ).replace("FROM u", "FROM (SELECT *, trim(regexp_extract(u, 'reprogramacao\\s*(stage\\s*\\d)?(\\s*\\w+)?')) AS m0, trim(regexp_extract(u, 'stage\\s*[12]\\b[^,.)]*')) AS m1 FROM u)"),
)
def _(t: Tables) -> DataFrame:
    return spoken(t).select("id", F.concat_ws(",", x.tuning(F.col("text"))).alias("tuning"))


MAINTENANCE_SQL = r"""rules(k, label, p) AS (VALUES (1, 'correia distribuição', 'correia\s+d[eo]\s+distribuicao[\w\s,]*(troca|feita|nova|substituida|aos\s+\d+)'),
    (2, 'kit distribuição', 'kit\s+distribuicao[\w\s,]*(troca|feita|nova|substituida|aos\s+\d+)'), (3, 'embreagem nova', 'embrai?agem\s+(nova|trocada|substituida|feita)|embreagem\s+(nova|trocada|substituida|feita)'),
    (4, 'travões', '(trocou|trocad[oa]s?|novos?|novas?).{0,30}(travoes|pastilhas)'), (5, 'pastilhas/discos travão', '(pastilhas|discos)\s+d[eo]\s+travao\s+(nov[oa]s?|trocad[oa]s?)'),
    (6, 'bomba de água', 'bomba\s+d[eo]\s+agua\s+(nova|trocada)'), (7, 'revisão', 'revisao\s+(feita|completa|geral|na\s+marca)'), (8, 'óleo e filtros', 'oleo\s+(e\s+filtros?\s+)?(trocad|mudad|feita)'),
    (9, 'filtros', 'filtros?\s+(trocad|novos?|mudad)'), (10, 'amortecedores', 'amortecedores?\s+(novos?|trocad)'), (11, 'molas', 'molas?\s+(novas?|trocad)'), (12, 'bateria nova', 'bateria\s+(nova|trocada)'),
    (13, 'pneus', 'pneus?\s+(novos?|trocad)'), (14, 'bomba combustível', 'bomba\s+d[eo]\s+combustivel\s+(nova|trocada)'), (15, 'juntas homocinéticas', 'juntas?\s+homo[\s-]?cineticas?\s+(novas?|trocad)'),
    (16, 'volante do motor', 'volante\s+d[eo]\s+motor\s+(novo|trocado)'), (17, 'turbo', 'turbo\s+(novo|recondicionado|trocad)'), (18, 'injetores', 'injetores?\s+(novos?|recondicionad|trocad)'),
    (19, 'bomba direção', 'bomba\s+d[eo]\s+direc[cç][aã]o\s+(nova|trocada)'), (20, 'radiador', 'radiador\s+(novo|trocad)'), (21, 'alternador', 'alternador\s+(novo|trocad)'),
    (22, 'motor de arranque', 'motor\s+d[eo]\s+arranque\s+(novo|trocad)'), (23, 'valvulina caixa', 'valvulina\s+(trocada|nova|mudada)')),
    hits AS (SELECT id, k, label, u, length(regexp_extract(u, '(?s)^(.*?)(?:' || p || ')', 1)) AS before, length(regexp_extract(u, p)) AS n FROM u JOIN rules ON regexp_matches(u, p)),
    told AS (SELECT id, string_agg(label || CASE WHEN km = '' THEN '' ELSE ' (' || replace(km, '.', '') || 'km)' END, ',' ORDER BY k) AS done
      FROM (SELECT *, regexp_extract(substring(u, greatest(before - 39, 1), before + n + 41 - greatest(before - 39, 1)), '(\d[\d.]*)\s*km', 1) AS km FROM hits) GROUP BY 1)"""


@query("x18_maintenance", unaccented_sql("coalesce(done, CASE WHEN regexp_matches(u, '(pecas|material)\\s+trocad\\w*[\\s:]*\\n') THEN 'múltiplas peças trocadas (ver descrição)' ELSE '' END) AS maintenance", f", {MAINTENANCE_SQL}") + " LEFT JOIN told USING (id)")
def _(t: Tables) -> DataFrame:
    return spoken(t).select("id", F.concat_ws(",", x.maintenance(F.col("text"))).alias("maintenance"))


@query("b18_severity_transitions", f"WITH {SPOKEN_SQL}, f AS (SELECT *, {FOLD.format('text')} AS t FROM spoken), r AS (SELECT CAST(size % 4 AS INT) AS old, {SEVERITY_SQL} AS new FROM f) SELECT old, new, count(*) AS n FROM r WHERE old <> new GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    from ..operators.maintain import transitions

    return transitions((F.col("size") % 4).cast("int"), severity(), spoken(t))


BRAND_SPELLINGS = "CASE n_nationkey % 4 WHEN 0 THEN ' VW ' WHEN 1 THEN 'skoda' WHEN 2 THEN n_name END"


@query("x01_canonical_brand", f"WITH b AS (SELECT n_nationkey, {BRAND_SPELLINGS} AS b FROM nation) SELECT n_nationkey, CASE lower(trim(b)) WHEN 'vw' THEN 'Volkswagen' WHEN 'skoda' THEN 'Skoda' ELSE coalesce(trim(b), '') END AS brand FROM b")
def _(t: Tables) -> DataFrame:
    k = F.col("n_nationkey") % 4
    return t.nation.select("n_nationkey", x.canonical_brand(F.when(k == 0, " VW ").when(k == 1, "skoda").when(k == 2, F.col("n_name"))).alias("brand"))


@query("x02_canonical_colour", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'cinzento' WHEN 1 THEN 'preto' WHEN 2 THEN lower(trim(p_name)) END AS colour FROM part")
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    return t.part.select("p_partkey", x.canonical_colour(F.when(k == 0, "Prata ").when(k == 1, "BLACK").when(k == 2, F.col("p_name")).otherwise(" ")).alias("colour"))


@query("x04_url_slug", "SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]+)', 1), '') AS slug FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", x.slug_part(F.col("url"), 1).alias("slug"))


@query("x06_advert_id", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'a' || page_id || '_Z' END AS id FROM pages")
def _(t: Tables) -> DataFrame:
    k = F.col("page_id")
    url = F.concat(F.coalesce("url", F.lit("")), F.when(k % 3 == 0, F.concat(F.lit("-carro-ID"), F.concat(F.lit("a"), k.cast("string"), F.lit("_Z")), F.lit(".html?x=ID9.html"))).when(k % 3 == 1, "/ID.html").otherwise("/ID12.htm"))
    return t.pages.select("page_id", x.advert_id(url).alias("id"))


@query("x06_url_number", "SELECT page_id, nullif(regexp_extract(url, '/(\\d+)(?:\\.html)?/?(?:[?#].*)?$', 1), '') AS id FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", x.last_number(F.col("url")).alias("id"))


@query(
    "x07_price_text",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN floor(o_totalprice) + 0.5 WHEN 2 THEN floor(o_totalprice) WHEN 3 THEN o_orderkey % 100 + 0.5 WHEN 4 THEN NULL ELSE floor(o_totalprice) END::DOUBLE AS price FROM orders""",
)
def _(t: Tables) -> DataFrame:
    k, whole = F.col("o_orderkey") % 6, F.translate(F.format_number(F.floor("o_totalprice"), 0), ",", ".")
    written = (
        F.when(k == 0, F.concat(whole, F.lit(" € negociável 123")))
        .when(k == 1, F.concat(whole, F.lit(",50 EUR")))
        .when(k == 2, F.concat(F.lit("€ "), whole))
        .when(k == 3, F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit(".5")))
        .when(k == 4, F.concat(F.lit("Preço "), whole))
        .otherwise(F.concat(F.floor("o_totalprice").cast("string"), F.lit(" €")))
    )
    return t.orders.select("o_orderkey", x.price_eur(written).alias("price"))


@query("x08_digits", "SELECT c_custkey, TRY_CAST(regexp_replace(c_name, '\\D', '', 'g') AS BIGINT) AS n FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", x.digits(F.col("c_name")).alias("n"))


@query(
    "x09_fixed_mileage",
    """WITH k AS (SELECT p_partkey, p_size * 40 AS km, CASE WHEN p_partkey % 7 > 0 THEN greatest(1, 2024 - (2010 + p_partkey % 15)) END AS age FROM part)
    SELECT p_partkey, CASE WHEN km >= 1000 THEN km WHEN age IS NULL OR km < 500 * age OR 1000 * km >= 3000 * age AND 1000 * km <= 40000 * age THEN 1000 * km ELSE km END AS km FROM k""",
)
def _(t: Tables) -> DataFrame:
    year = F.when(F.col("p_partkey") % 7 > 0, 2010 + F.col("p_partkey") % 15)
    return t.part.select("p_partkey", x.fixed_mileage(F.col("p_size") * 40, year, 2024).alias("km"))


@query(
    "x27_sub_segment",
    """WITH f AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'diesel' WHEN 1 THEN 'petrol' WHEN 2 THEN 'electric' WHEN 3 THEN 'hybrid' WHEN 4 THEN 'gpl' WHEN 5 THEN 'unk' ELSE 'diesel' END AS fuel,
      CASE WHEN p_size % 9 > 0 THEN p_size * 60 - 60 END AS cc FROM part)
    SELECT p_partkey, fuel || CASE WHEN fuel = 'electric' OR coalesce(cc, 0) <= 0 THEN '' WHEN cc < 1400 THEN '_small' WHEN cc <= 2000 THEN '_mid' ELSE '_large' END AS sub_segment FROM f""",
)
def _(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("Diesel", "Gasolina", "Eléctrico", "Híbrido", "GPL", None, "Híbrido (Diesel)")])
    size = F.when(F.col("p_size") % 9 > 0, F.col("p_size") * 60 - 60)
    return t.part.select("p_partkey", s.sub_segment(F.get(words, (F.col("p_partkey") % 7).cast("int")), size).alias("sub_segment"))


@query(
    "x28_repair_cost",
    "SELECT p_partkey, CAST(CASE WHEN p_size % 5 < 2 THEN 0 WHEN p_size % 5 >= 3 THEN p_retailprice WHEN p_partkey % 2 = 0 THEN greatest(0.18::DOUBLE * p_retailprice, 1500) ELSE greatest(0.12::DOUBLE * p_retailprice, 1000) END AS DOUBLE) AS cost FROM part",
)
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", s.repair_cost(F.col("p_size") % 5, F.col("p_retailprice"), F.col("p_partkey") % 2 == 0).alias("cost"))


@query("x29_adaptive_window", "SELECT p_partkey, CAST(CASE WHEN p_size % 5 > 0 THEN least(greatest(8 * p_size, 60), 365) ELSE 180 END AS BIGINT) AS days FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", s.adaptive_window(F.when(F.col("p_size") % 5 > 0, F.col("p_size") * 2.0)).alias("days"))


@query("x31_price_bucket", "SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1500 THEN 'mid' ELSE 'high' END AS tier FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", s.bucket(F.col("p_retailprice"), [0, 1000, 1500], ["low", "mid", "high"]).alias("tier"))


@query("x35_md5_split", "SELECT doc_id, round(CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) / 4294967295.0, 9)::DOUBLE AS share FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(s.md5_share(F.col("doc_id")), 9).alias("share"))


@query("x38_json_values", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') IS NOT NULL AS has_k FROM events")
def _(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", k.try_cast("long").alias("k"), k.isNotNull().alias("has_k"))


@query("x39_zones", "SELECT olx_id, r_name AS zone FROM listings LEFT JOIN nation ON n_name = district LEFT JOIN region ON n_regionkey = r_regionkey")
def _(t: Tables) -> DataFrame:
    zones = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("place"), F.col("r_name").alias("zone"))
    return with_zone(t.listings, zones, "district").select("olx_id", "zone")


@query("a17_evolved", "SELECT event_id, NULL::VARCHAR AS note, json_extract_string(props, '$.k') AS k, props NOT LIKE '%dead%' AS clean, 2 AS version FROM events")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import types as T

    from ..sources.tables import evolved

    rows = t.events.select("event_id", F.regexp_replace("props", r"\}$", ',"dead":1}').alias("props"), F.lit(1).alias("old"))
    steps = {1: {"schema": T.StructType(), "drop": ["event_id"]}, 2: {"schema": T.StructType().add("note", "string"), "drop": ["old"], "json_column": "props", "dead_keys": ["dead", "gone"]}}
    out, version = evolved(rows, 1, steps)
    return out.select("event_id", "note", F.get_json_object("props", "$.k").alias("k"), (~F.col("props").contains("dead")).alias("clean"), F.lit(version).alias("version"))


LINK = 'href="([^"?#]*)'


@query("p06_page_links", f"SELECT page_id, count(*) AS links, count(DISTINCT u) AS distinct_links FROM (SELECT page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) AS u FROM pages) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(LINK), 1)
    return t.pages.select("page_id", F.size(links).cast("long").alias("links"), F.size(F.array_distinct(links)).cast("long").alias("distinct_links")).where("links > 0")


DEAD_SQL = " OR ".join(f"contains(body, '{mark}')" for mark in (
    "anúncio que tentas aceder não existe ou foi eliminado", "anúncio que pretende aceder não existe", "this advert no longer exists", "página que estás à procura não existe",
    "página não encontrada", "anúncio não disponível", "anúncio que procuras não está disponível"))


@query(
    "p07_dead_pages",
    f"""WITH p AS (SELECT page_id, lower(html || CASE page_id % 9 WHEN 0 THEN 'O Anúncio que procuras NÃO está disponível' WHEN 1 THEN '<h1>Página não encontrada</h1>' WHEN 2 THEN 'This advert no longer exists.' WHEN 3 THEN 'anúncio disponível' ELSE '' END) AS body,
      CASE WHEN page_id % 10 = 4 THEN 404 WHEN page_id % 10 = 7 THEN 410 WHEN page_id % 10 = 5 THEN 503 WHEN page_id % 10 = 6 THEN 301 WHEN page_id % 10 = 8 THEN 403 ELSE 200 END AS status FROM pages)
    SELECT page_id, CASE WHEN status IN (404, 410) THEN true WHEN status = 200 THEN {DEAD_SQL} END AS dead FROM p""",
)
def _(t: Tables) -> DataFrame:
    k, m = F.col("page_id") % 10, F.col("page_id") % 9
    status = F.when(k == 4, 404).when(k == 7, 410).when(k == 5, 503).when(k == 6, 301).when(k == 8, 403).otherwise(200)
    said = F.when(m == 0, "O Anúncio que procuras NÃO está disponível").when(m == 1, "<h1>Página não encontrada</h1>").when(m == 2, "This advert no longer exists.").when(m == 3, "anúncio disponível").otherwise("")
    return t.pages.select("page_id", x.page_is_dead(status, F.concat("html", said)).alias("dead"))
