"""SQL for each registered query, written independently of the DataFrame code."""

from __future__ import annotations

from roadstats.plans.views import oracle_view


def _paving(otherwise: str) -> str:
    return f"""CASE
 WHEN Pavimentazione IN ('Asfaltata','In conglomerato cementizio','Bitumata') THEN 'Asfaltata'
 WHEN Pavimentazione IN ('Con buche','Strada pavimentata dissestata') THEN 'Dissestata'
 WHEN Pavimentazione IN ('Lastricata','In cubetti di porfido','Acciotolata') THEN 'Lastricata'
 WHEN Pavimentazione IN ('Sterrata','Inghiaiata','Fondo naturale') THEN 'Sterrata'
 ELSE {otherwise} END"""


_BORN = "2016-cast(try_cast(AnnoNascita AS int) AS bigint)"
_AGE = f"""CASE WHEN {_BORN} IS NULL THEN 'non-identificato' WHEN {_BORN}<26 THEN '18-25' WHEN {_BORN}<40 THEN '26-39'
 WHEN {_BORN}<70 THEN '40-69' WHEN {_BORN}<100 THEN '71-99' ELSE 'non-identificato' END"""
_DRIVER_AGE = f"CASE WHEN TipoPersona='Conducente' THEN {_AGE} ELSE 'non-identificato' END"


def _number(i: int) -> str:
    pattern = r"^\s*(\d+)/[ \t]*(\d+)/[ \t]*(\d+)(?: [ \t]*(\d+):[ \t]*(\d+):[ \t]*(\d+))?"
    return f"try_cast(nullif(regexp_extract(trim(DataOraIncidente), '{pattern}', {i}), '') AS int)"


# Steps shared by several queries. Each is a WITH item over the views.
_STEPS = {
    "quando": f"""SELECT ID, Gruppo, h0, make_timestamp(y,1,1,0,0,0.0)+to_months(mo-1)+to_days(d-1)+to_hours(coalesce(h0,0))+to_minutes(coalesce(mi,0))+to_seconds(coalesce(sc,0)) AS ts
 FROM (SELECT ID, Gruppo, {_number(1)} AS d, {_number(2)} AS mo, {_number(3)} AS y, {_number(4)} AS h0, {_number(5)} AS mi, {_number(6)} AS sc FROM incidenti)""",
    "ore": """SELECT ID, trim(Gruppo) AS Gruppo, ts,
 CASE dayofweek(ts) WHEN 0 THEN 'Domenica' WHEN 1 THEN 'Lunedi' WHEN 2 THEN 'Martedi' WHEN 3 THEN 'Mercoledi' WHEN 4 THEN 'Giovedi' WHEN 5 THEN 'Venerdi' WHEN 6 THEN 'Sabato' ELSE 'non-definito' END AS Giorno,
 CASE WHEN ts IS NULL OR h0 IS NULL THEN 'non-definita' WHEN hour(ts)<6 THEN '0-6' WHEN hour(ts)<9 THEN '7-9' WHEN hour(ts)<13 THEN '10-13' WHEN hour(ts)<17 THEN '14-17' WHEN hour(ts)<20 THEN '18-20' ELSE '21-24' END AS FasciaOraria FROM quando""",
    "tipi": "SELECT trim(Gruppo) AS Gruppo, trim(NaturaIncidente) AS TipoIncidente, count(*) AS n FROM incidenti WHERE trim(Gruppo)<>'' AND trim(NaturaIncidente)<>'' GROUP BY 1,2",
    "fasce_ore": "SELECT Gruppo, Giorno, FasciaOraria, count(*) AS n FROM ore WHERE Gruppo<>'' GROUP BY 1,2,3",
    "cond_l": f"""SELECT trim(Gruppo) AS g,'Pavimentazione' AS dim,{_paving('NULL')} AS v FROM incidenti
 UNION ALL SELECT trim(Gruppo),'Traffico',trim(Traffico) FROM incidenti UNION ALL SELECT trim(Gruppo),'Segnaletica',trim(Segnaletica) FROM incidenti""",
    "cond_n": "SELECT g, dim, v, count(*) AS n FROM cond_l WHERE g<>'' AND v<>'' GROUP BY g, dim, v",
    "cond": "SELECT g AS Gruppo, dim, v AS valore, n FROM cond_n WHERE g IN (SELECT g FROM cond_n GROUP BY g HAVING count(DISTINCT dim)=3)",
    "ped_z": "SELECT i.* FROM incidenti i JOIN pedoni ON ID=IDProtocollo",
    "ped_l": "SELECT Gruppo,'Segnaletica' AS dim,Segnaletica AS v FROM ped_z UNION ALL SELECT Gruppo,'Visibilita',Visibilita FROM ped_z UNION ALL SELECT Gruppo,'Illuminazione',Illuminazione FROM ped_z",
    "ped": "SELECT Gruppo AS Municipio, dim, v AS valore, count(*) AS n FROM ped_l WHERE Gruppo<>'' AND v<>'' GROUP BY 1,2,3",
    "guida": f"SELECT Gruppo AS Municipio, {_AGE} AS FasciaEta, coalesce(Sesso,'') AS Sesso, count(*) AS n FROM incidenti JOIN persone ON ID=IDProtocollo WHERE TipoPersona='Conducente' AND Gruppo<>'' GROUP BY 1,2,3",
    "marche": "SELECT Marca, coalesce(NaturaIncidente,'') AS TipoIncidente, FondoStradale, count(*) AS NumIncidenti FROM incidenti JOIN veicoli ON ID=IDProtocollo WHERE Marca<>'' GROUP BY 1,2,3",
    # Scenario: the set of an accident's items, counted once; then its subsets of
    # one, two and three items, and every (antecedent, consequent) among them.
    "sc": f"SELECT '' AS g, {_paving('upper(Pavimentazione)')} AS a, Illuminazione AS b, NaturaIncidente AS c FROM incidenti",
    "sc_g": f"SELECT trim(Gruppo) AS g, {_paving('upper(Pavimentazione)')} AS a, Illuminazione AS b, NaturaIncidente AS c FROM incidenti WHERE trim(Gruppo)<>''",
    "sc_n": "SELECT g, s, s[1] AS i, s[2] AS j, s[3] AS k, count(*) AS n FROM (SELECT g, list_sort(list_distinct([a,b,c])) AS s FROM sc) GROUP BY 1,2",
    "sc_sets": """SELECT g, items, cast(sum(n) AS bigint) AS n FROM (
 SELECT g, [i] AS items, n FROM sc_n WHERE i IS NOT NULL UNION ALL SELECT g, [j], n FROM sc_n WHERE j IS NOT NULL UNION ALL SELECT g, [k], n FROM sc_n WHERE k IS NOT NULL
 UNION ALL SELECT g, [i,j], n FROM sc_n WHERE j IS NOT NULL UNION ALL SELECT g, [i,k], n FROM sc_n WHERE k IS NOT NULL UNION ALL SELECT g, [j,k], n FROM sc_n WHERE k IS NOT NULL
 UNION ALL SELECT g, [i,j,k], n FROM sc_n WHERE k IS NOT NULL) GROUP BY 1,2""",
    "sc_pairs": """SELECT g, ante, cons, sum(n) AS n FROM (
 SELECT g, [i] AS ante, j AS cons, n FROM sc_n WHERE j IS NOT NULL UNION ALL SELECT g, [j], i, n FROM sc_n WHERE j IS NOT NULL
 UNION ALL SELECT g, [i], k, n FROM sc_n WHERE k IS NOT NULL UNION ALL SELECT g, [k], i, n FROM sc_n WHERE k IS NOT NULL
 UNION ALL SELECT g, [j], k, n FROM sc_n WHERE k IS NOT NULL UNION ALL SELECT g, [k], j, n FROM sc_n WHERE k IS NOT NULL
 UNION ALL SELECT g, [i,j], k, n FROM sc_n WHERE k IS NOT NULL UNION ALL SELECT g, [i,k], j, n FROM sc_n WHERE k IS NOT NULL UNION ALL SELECT g, [j,k], i, n FROM sc_n WHERE k IS NOT NULL) GROUP BY 1,2,3""",
    "sc_rules": """SELECT p.g, p.ante, p.cons, cast(p.n AS double)/cast(s.n AS double) AS confidence FROM sc_pairs p
 JOIN sc_sets s ON p.g = s.g AND array_to_string(p.ante, chr(31)) = array_to_string(s.items, chr(31))""",
    # Persons: municipality, sex, band of drivers, type.
    "pe": f"SELECT Gruppo AS a, Sesso AS b, {_DRIVER_AGE} AS f, NaturaIncidente AS c FROM incidenti JOIN persone ON ID=IDProtocollo",
    "base": "SELECT NaturaIncidente AS item, cast(count(*) AS double)/cast((SELECT count(*) FROM incidenti) AS double) AS freq FROM incidenti GROUP BY NaturaIncidente HAVING NaturaIncidente IS NOT NULL",
    "pe_n": "SELECT a, b, f, c, count(*) AS n FROM pe GROUP BY 1,2,3,4",
    "pe_rules": "SELECT a, b, f, c, cast(n AS double)/cast(sum(n) OVER (PARTITION BY a,b,f) AS double) AS confidence FROM pe_n",
}

_VIEWS = ["incidenti", "persone", "veicoli", "pedoni", "grezzi", "crosswalk"]
_RULES = ("sc", "sc_n", "sc_sets", "sc_pairs", "sc_rules")
_JOINED = "array_to_string(%s, ' + ')"
_SCORE = "round(CASE WHEN confidence=1 THEN cast('Infinity' AS double) ELSE 1/abs(log10(confidence)) END, 9)"


def _with(select: str, *steps: str) -> str:
    """``select`` with the views and steps it needs in front, in order; ``a=b`` names step b a."""
    text = " ".join([select, *(_STEPS[s.split("=")[-1]] for s in steps)])
    views = [v for v in _VIEWS if v in text]
    items = [f"{v} AS ({oracle_view(v)})" for v in views]
    # Steps that several others read are computed once.
    items += [f"{s.split('=')[0]} AS MATERIALIZED ({_STEPS[s.split('=')[-1]]})" for s in steps]
    return "WITH " + ",\n".join(items) + "\n" + select


def _scenario(where: str) -> str:
    return _with(
        f"SELECT {_JOINED % 'ante'} AS antecedent, cons AS consequent, confidence, {_SCORE} AS score FROM sc_rules WHERE {where}",
        *_RULES,
    )


def _driver(where: str) -> str:
    return _with(
        f"""SELECT {_JOINED % 'list_sort([a,b,f])'} AS antecedent, c AS consequent, confidence, round(confidence/freq, 9) AS ratio
 FROM pe_rules JOIN base ON c=item WHERE a<>'' AND b<>'' AND {where}""",
        "pe", "base", "pe_n", "pe_rules",
    )


_VIA = """CASE k % 12 WHEN 1 THEN 'ROMA CENTRO NORD' WHEN 2 THEN 'ROMA, CENTRO, NORD' WHEN 3 THEN 'a b c d' WHEN 4 THEN 'ab' WHEN 5 THEN '' WHEN 6 THEN 'x y z w' ELSE 'VIA ' || o_orderstatus END"""
_NO_CUT = "k % 500 NOT IN (497, 499) AND k % 200 <> 3"
_FIX_NAME = "regexp_replace(value, 'ANNA \"(.)\" ROSSI', 'ANNA \\1 ROSSI')"
_FIX_EMPTY = f"replace({_FIX_NAME}, '\"Via\":\"\"\",', '\"Via\":\"\",')"
_FIX_FEW = f"replace({_FIX_EMPTY}, '\"CENTRO\"', 'CENTRO')"
_FIX_MANY = f"replace(replace(replace({_FIX_EMPTY}, 'ROMA \"CENTRO\"', 'ROMA CENTRO'), 'a \"b\" c\" d', 'a b c d'), '\"x\" \"y\" \"z\" w', 'x y z w')"
# Two records in a line, and a line with text after its record.
_TWO = "k % 500 IN (496, 498)"
_RECORDS = f"""SELECT cast(k AS varchar) AS ID, CASE WHEN {_TWO} THEN 'UNO' ELSE {_VIA} END AS Via, CASE WHEN {_TWO} THEN NULL ELSE o_orderpriority END AS NaturaIncidente, CASE WHEN {_TWO} THEN NULL ELSE cast(o_custkey % 15 + 1 AS varchar) END AS Gruppo FROM (SELECT o_orderkey AS k, * FROM orders) WHERE {_NO_CUT}
 UNION ALL SELECT cast(-o_orderkey AS varchar), 'DUE', NULL, NULL FROM orders WHERE o_orderkey % 500 IN (496, 498)"""

_PERSONS = """SELECT 'persone' AS entity, cast(l_orderkey AS varchar) AS chiave, l_linestatus AS uno, 'ANNA ' || l_returnflag || ' ROSSI' AS due, NULL AS tre FROM lineitem WHERE (l_orderkey * 7 + l_linenumber) % 333 <> 5"""
# Nine fields of an accident as field=value items, and the subsets of each set.
_NINE = ["Pavimentazione", "Illuminazione", "NaturaIncidente", "Segnaletica", "Visibilita", "Traffico", "FondoStradale", "Giorno", "FasciaOraria"]
_STEPS["nove"] = f"""SELECT ore.Gruppo AS g, list_sort(list_filter([{", ".join(f"'{c}=' || " + (_paving("NULL") if c == "Pavimentazione" else f"nullif({'ore' if c in ('Giorno', 'FasciaOraria') else 'i'}.{c}, '')") for c in _NINE)}], lambda x: x IS NOT NULL)) AS s
 FROM (SELECT row_number() OVER () AS r, * FROM incidenti) i JOIN (SELECT row_number() OVER () AS r, * FROM ore) ore USING (r) WHERE ore.Gruppo<>''"""
_STEPS["nove_n"] = "SELECT g, s, count(*) AS n FROM nove GROUP BY 1,2"
_STEPS["nove_sets"] = "SELECT g, list_filter(s, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items, cast(sum(n) AS bigint) AS n FROM nove_n, range(1, 512) AS t(m) WHERE m < power(2, len(s)) GROUP BY 1,2"
_STEPS["alla_guida"] = f"SELECT ID, Gruppo AS Municipio, {_AGE} AS FasciaEta, coalesce(Sesso,'') AS Sesso FROM incidenti JOIN persone ON ID=IDProtocollo WHERE TipoPersona='Conducente' AND Gruppo<>''"
_STEPS["nove_frequenti"] = "SELECT g, items, n FROM nove_sets JOIN (SELECT g, ceil(0.1 * count(*)) AS least FROM nove GROUP BY 1) USING (g) WHERE n >= least"
# Larger sets of the same group, among all of any size.
_MARKS = """NOT EXISTS (SELECT 1 FROM %s t WHERE t.g=s.g AND t.n=s.n AND len(t.items)>len(s.items) AND list_has_all(t.items, s.items)) AS chiuso,
 NOT EXISTS (SELECT 1 FROM %s u WHERE u.g=s.g AND len(u.items)>len(s.items) AND list_has_all(u.items, s.items)) AS massimale"""
_STEPS["nove_ventesimo"] = "SELECT g, items, n FROM nove_sets JOIN (SELECT g, ceil(0.05 * count(*)) AS least FROM nove GROUP BY 1) USING (g) WHERE n >= least"
# Contingency counts of every rule, and erfc by the trapezoidal rule (step 1/2), whose
# correction is for arguments below pi over the step.
_STEPS["conti"] = """SELECT r.*, a.n AS n_antecedent, c.n AS n_consequent, t.records FROM (SELECT g, list_filter(items, lambda x: x <> cons) AS ante, cons, n, items FROM (SELECT *, unnest(items) AS cons FROM sc_sets WHERE len(items) > 1)) r
 JOIN sc_sets a ON a.g=r.g AND a.items=r.ante JOIN sc_sets c ON c.g=r.g AND c.items=[r.cons] JOIN (SELECT g, cast(sum(n) AS bigint) AS records FROM sc_n GROUP BY 1) t ON t.g=r.g"""
_STEPS["prova"] = """SELECT *, min(p*count_all/rank_p) OVER (ORDER BY chi2 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM (SELECT *, count(*) OVER () AS count_all, count(*) OVER (ORDER BY chi2 DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank_p FROM (
 SELECT *, CASE WHEN z < 1e-7 THEN 1.0 ELSE z/pi()*exp(-z*z)*(1/(2*z*z) + list_sum(list_transform(range(1, 15), lambda k: exp(-k*k*0.25)/(z*z+k*k*0.25)))) + CASE WHEN z < 2*pi() THEN 2/(1-exp(4*pi()*z)) ELSE 0 END END AS p FROM (SELECT *, sqrt(chi2/2) AS z FROM (
 SELECT *, CASE WHEN n_antecedent=records OR n_consequent=records THEN 0.0 ELSE power(n*1.0*(records-n_antecedent-n_consequent+n)-(n_antecedent-n)*1.0*(n_consequent-n), 2)*records/(n_antecedent*1.0*n_consequent*(records-n_antecedent)*(records-n_consequent)) END AS chi2 FROM sc_conti))))"""
_TESTED = "n, n_antecedent, n_consequent, records, round(n_antecedent*n_consequent/records, 6) AS atteso, round(chi2, 6) AS chi2, round(p, 9) AS p, round(least(1, q), 9) AS p_corretto"
# Each protocol number in the four entities.
_STEPS["presenze"] = """SELECT chiave, cast(count(*) FILTER (e='incidenti') AS bigint) AS incidenti, cast(count(*) FILTER (e='persone') AS bigint) AS persone, cast(count(*) FILTER (e='pedoni') AS bigint) AS pedoni, cast(count(*) FILTER (e='veicoli') AS bigint) AS veicoli FROM (
 SELECT ID AS chiave, 'incidenti' AS e FROM incidenti UNION ALL SELECT IDProtocollo, 'persone' FROM persone UNION ALL SELECT IDProtocollo, 'pedoni' FROM pedoni UNION ALL SELECT IDProtocollo, 'veicoli' FROM veicoli) GROUP BY 1"""


def _entity(name: str, key: str, lone: str) -> str:
    return f"""SELECT '{name}' AS entita, count(*) AS righe, count(DISTINCT {key}) AS chiavi, count(*) FILTER ({key} IS NULL) AS senza_chiave,
 (SELECT count(*) FROM (SELECT {key} FROM {name} WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(*)>1)) AS ripetute,
 count(DISTINCT {key}) FILTER ({lone}) AS spaiate, count(*) FILTER ({lone}) AS righe_spaiate FROM {name}"""


_STEPS["giorni"] = "SELECT Gruppo, giorno, count(*) AS n FROM (SELECT trim(i.Gruppo) AS Gruppo, cast(q.ts AS date) AS giorno FROM (SELECT row_number() OVER () AS r, * FROM incidenti) i JOIN (SELECT row_number() OVER () AS r, * FROM quando) q USING (r)) WHERE Gruppo<>'' AND giorno IS NOT NULL GROUP BY 1,2"
_STEPS["mesi"] = "SELECT Gruppo, TipoIncidente, cast(date_trunc('month', ts) AS date) AS mese, count(*) AS n FROM (SELECT trim(i.Gruppo) AS Gruppo, trim(i.NaturaIncidente) AS TipoIncidente, q.ts FROM (SELECT row_number() OVER () AS r, * FROM incidenti) i JOIN (SELECT row_number() OVER () AS r, * FROM quando) q USING (r)) WHERE Gruppo<>'' AND TipoIncidente<>'' AND ts IS NOT NULL GROUP BY 1,2,3"


def _monthly(first: str, last: str) -> str:
    return f"""SELECT Gruppo, TipoIncidente, mese, n, round(avg(n) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 9) AS media, lag(n, 12) OVER w AS anno_prima,
 round(cast(n - lag(n, 12) OVER w AS double) / nullif(lag(n, 12) OVER w, 0), 9) AS variazione
 FROM (SELECT Gruppo, TipoIncidente, mese, coalesce(n, 0) AS n FROM (SELECT DISTINCT Gruppo, TipoIncidente FROM mesi WHERE mese BETWEEN {first} AND {last})
 CROSS JOIN (SELECT cast(unnest(generate_series({first}, {last}, INTERVAL 1 MONTH)) AS date) AS mese) LEFT JOIN mesi USING (Gruppo, TipoIncidente, mese))
 WINDOW w AS (PARTITION BY Gruppo, TipoIncidente ORDER BY mese)"""


_LINE = "'[' || array_to_string(list_sort([a,b,f]), ', ') || '] => [' || c || '], ' || cast(cast(round(confidence/freq, 4) AS decimal(18,4)) AS varchar)"

ORACLE: dict[str, str] = {
    "group_count": _with("SELECT trim(Gruppo) AS Municipio, count(*) AS NumIncidenti FROM incidenti WHERE trim(Gruppo)<>'' GROUP BY 1"),
    "types": _with("SELECT *, row_number() OVER (PARTITION BY Gruppo ORDER BY n DESC, TipoIncidente) AS pos FROM tipi", "tipi"),
    "times": _with("SELECT *, row_number() OVER (PARTITION BY Gruppo, Giorno ORDER BY n DESC, FasciaOraria) AS pos FROM fasce_ore", "quando", "ore", "fasce_ore"),
    "conditions": _with("SELECT * FROM cond", "cond_l", "cond_n", "cond"),
    "pedestrian": _with("SELECT * FROM ped", "ped_z", "ped_l", "ped"),
    "drivers": _with("SELECT *, row_number() OVER (PARTITION BY Municipio, FasciaEta ORDER BY n DESC, Sesso) AS pos FROM guida", "guida"),
    "makes": _with("SELECT * FROM marche", "marche"),
    "scenario_rules": _scenario("len(ante)>=2 AND NOT list_contains(ante, '')"),
    "scenario_rules_fpgrowth": _scenario("len(ante)>=2 AND NOT list_contains(ante, '')"),
    "driver_rules": _driver("confidence/freq>=0.1"),
    "driver_rules_strict": _driver("confidence/freq>=1.2"),
    "driver_rules_fpgrowth": _driver("confidence/freq>=0.1"),
    "driver_rules_file": _driver("confidence/freq>=0.1"),
    "scenario_rules_custom": _with(f"SELECT {_JOINED % 'ante'} AS antecedent, cons AS consequent, confidence, round(confidence*confidence, 9) AS score FROM sc_rules WHERE len(ante)>=2 AND NOT list_contains(ante, '')", *_RULES),
    "scenario_rules_by_group": _with(f"SELECT g AS Gruppo, {_JOINED % 'ante'} AS antecedent, cons AS consequent, confidence, {_SCORE} AS score FROM sc_rules WHERE len(ante)>=2 AND NOT list_contains(ante, '')", "sc=sc_g", "sc_n", "sc_sets", "sc_pairs", "sc_rules"),
    "driver_rules_by_group": _with(f"SELECT a AS Gruppo, {_JOINED % 'list_sort([b,f])'} AS antecedent, c AS consequent, confidence, round(confidence/freq, 9) AS ratio FROM pe_rules JOIN base ON c=item WHERE a<>'' AND b<>'' AND confidence/freq>=0.1", "pe", "base", "pe_n", "pe_rules"),
    "scenario_lines": _with(f"SELECT '[' || array_to_string(ante, ', ') || '] => [' || cons || '], ' || CASE WHEN confidence=1 THEN 'Infinity' ELSE cast(cast(round({_SCORE}, 4) AS decimal(18,4)) AS varchar) END AS value FROM sc_rules WHERE len(ante)>=2 AND NOT list_contains(ante, '')", *_RULES),
    "rules_read_back": _with(f"SELECT {_LINE} AS value, count(*) OVER () AS kept FROM pe_rules JOIN base ON c=item WHERE a<>'' AND b<>'' AND confidence/freq>=0.1", "pe", "base", "pe_n", "pe_rules"),
    "driver_rules_one_group": _driver("confidence/freq>=0.1 AND a IN ('7','8')"),
    "group_documents": _with("SELECT cast(to_json({'Municipio': Municipio, 'NumIncidenti': NumIncidenti}) AS varchar) AS doc FROM (SELECT trim(Gruppo) AS Municipio, count(*) AS NumIncidenti FROM incidenti WHERE trim(Gruppo)<>'' GROUP BY 1)"),
    "nested_types": _with("SELECT cast(to_json({'Gruppo': Gruppo, 'Info': list({'TipoIncidente': TipoIncidente, 'Count': n} ORDER BY n DESC, TipoIncidente)}) AS varchar) AS doc FROM tipi GROUP BY Gruppo", "tipi"),
    "nested_times": _with("SELECT cast(to_json({'Gruppo': Gruppo, 'Info': list({'Giorno': Giorno, 'Info': i} ORDER BY Giorno)}) AS varchar) AS doc FROM (SELECT Gruppo, Giorno, list({'FasciaOraria': FasciaOraria, 'Count': n} ORDER BY n DESC, FasciaOraria) AS i FROM fasce_ore GROUP BY 1,2) GROUP BY Gruppo", "quando", "ore", "fasce_ore"),
    "nested_conditions": _with("SELECT cast(to_json({'Gruppo': Gruppo, 'Pavimentazione': list({'Tipo': valore, 'Count': n} ORDER BY valore) FILTER (dim='Pavimentazione'), 'Traffico': list({'Intensita': valore, 'Count': n} ORDER BY valore) FILTER (dim='Traffico'), 'Segnaletica': list({'Tipo': valore, 'Count': n} ORDER BY valore) FILTER (dim='Segnaletica')}) AS varchar) AS doc FROM cond GROUP BY Gruppo", "cond_l", "cond_n", "cond"),
    "nested_pedestrian": _with("SELECT cast(to_json({'Municipio': Municipio, 'info': {" + ", ".join(f"'{d}': map_from_entries(coalesce(list((valore, n) ORDER BY valore) FILTER (dim='{d}'), []))" for d in ("Segnaletica", "Visibilita", "Illuminazione")) + "}}) AS varchar) AS doc FROM ped GROUP BY Municipio", "ped_z", "ped_l", "ped"),
    "nested_drivers": _with("SELECT cast(to_json({'Municipio': Municipio, 'info': list({'FasciaEta': FasciaEta, 'Info': i} ORDER BY FasciaEta)}) AS varchar) AS doc FROM (SELECT Municipio, FasciaEta, list({'Sesso': Sesso, 'Count': n} ORDER BY n DESC, Sesso) AS i FROM guida GROUP BY 1,2) GROUP BY Municipio", "guida"),
    "nested_makes": _with("SELECT cast(to_json({'MarcaMacchina': Marca, 'Incidenti': list({'TipoIncidente': TipoIncidente, 'Condizioni': i} ORDER BY TipoIncidente)}) AS varchar) AS doc FROM (SELECT Marca, TipoIncidente, list({'FondoStradale': FondoStradale, 'NumIncidenti': NumIncidenti} ORDER BY FondoStradale) AS i FROM marche GROUP BY 1,2) GROUP BY Marca", "marche"),
    "itemset_accident": _with(f"SELECT {_JOINED % 'list_sort(list_distinct([a,b,c]))'} AS items FROM sc", "sc"),
    "itemset_person": _with(f"SELECT {_JOINED % 'list_sort(list_distinct([a,b,f,c]))'} AS items FROM pe", "pe"),
    "itemset_person_counted": _with(f"SELECT {_JOINED % 'list_sort(list_distinct([a,b,f,c]))'} AS items, count(*) AS n FROM pe GROUP BY 1", "pe"),
    "itemset_counts": _with(f"SELECT {_JOINED % 'items'} AS items, n FROM sc_sets WHERE len(items)>=2", "sc", "sc_n", "sc_sets"),
    "itemset_counts_tagged": _with(
        f"SELECT {_JOINED % 'items'} AS items, n FROM sc_sets", "sc", "sc_n", "sc_sets"
    ).replace(f"sc AS MATERIALIZED ({_STEPS['sc']})", f"sc AS (SELECT g, 'Pavimentazione=' || a AS a, 'Illuminazione=' || b AS b, 'NaturaIncidente=' || c AS c FROM ({_STEPS['sc']}))"),
    "itemset_counts_support": _with(f"SELECT {_JOINED % 'items'} AS items, n FROM sc_sets WHERE len(items)>=2 AND n >= ceil(0.02 * (SELECT count(*) FROM sc))", "sc", "sc_n", "sc_sets"),
    "rules_all": _with(f"SELECT {_JOINED % 'ante'} AS antecedent, cons AS consequent, confidence FROM sc_rules", *_RULES),
    "rules_confident": _with(f"SELECT {_JOINED % 'ante'} AS antecedent, cons AS consequent, confidence FROM sc_rules WHERE confidence>=0.25", *_RULES),
    "baseline_freq": _with("SELECT * FROM base", "base"),
    "baseline_scenario": _with("SELECT cons AS item, confidence AS freq FROM sc_rules WHERE ante=['Asfaltata','ill 1']", *_RULES),
    "scenario_rules_ratio": _with(f"SELECT {_JOINED % 'r.ante'} AS antecedent, r.cons AS consequent, round(r.confidence/b.confidence, 9) AS score FROM sc_rules r JOIN sc_rules b ON r.cons=b.cons WHERE b.ante=['Asfaltata','ill 1'] AND len(r.ante)>=2 AND NOT list_contains(r.ante, '')", *_RULES),
    "rule_text": _with("SELECT '[' || array_to_string(list_sort([a,b,f]), ', ') || '] => [' || c || '], ' || cast(cast(round(confidence/freq, 4) AS decimal(18,4)) AS varchar) AS value FROM pe_rules JOIN base ON c=item WHERE a<>'' AND b<>'' AND confidence/freq>=0.1", "pe", "base", "pe_n", "pe_rules"),
    "trimmed": _with("SELECT ID, trim(Gruppo) AS Gruppo FROM incidenti"),
    "age_bands": _with(f"SELECT AnnoNascita, {_AGE} AS FasciaEta, {_DRIVER_AGE} AS FasciaConducente, count(*) AS n FROM persone GROUP BY 1,2,3"),
    "when_parse": _with("SELECT ID, ts, Giorno, FasciaOraria FROM ore", "quando", "ore"),
    "paving_recode": _with(f"SELECT Pavimentazione, {_paving('NULL')} AS classe, {_paving('upper(Pavimentazione)')} AS classe_o_testo, count(*) AS n FROM incidenti GROUP BY 1,2,3"),
    "top_group": _with("SELECT trim(Gruppo) AS Municipio, count(*) AS NumIncidenti FROM incidenti WHERE trim(Gruppo)<>'' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    "group_recode": _with("SELECT coalesce(new, vecchio) AS Gruppo, count(*) AS n FROM (SELECT trim(Gruppo) AS vecchio, (SELECT arg_min(new, valid_before) FROM crosswalk WHERE old=trim(Gruppo) AND ts<valid_before) AS new FROM quando) WHERE coalesce(new, vecchio)<>'' GROUP BY 1", "quando"),
    "clean_group_drivers": _with("SELECT *, row_number() OVER (PARTITION BY Municipio, FasciaEta ORDER BY n DESC, Sesso) AS pos FROM (SELECT trim(Municipio) AS Municipio, FasciaEta, Sesso, cast(sum(n) AS bigint) AS n FROM guida GROUP BY 1,2,3)", "guida"),
    "quotes_few": _with(f"SELECT file_path, {_FIX_FEW} AS value FROM grezzi"),
    "quotes_many": _with(f"SELECT file_path, {_FIX_MANY} AS value FROM grezzi"),
    "normalised_lines": _with("SELECT entity, k, regexp_replace(replace(trim(value), chr(92), ''), ',$', '') AS value FROM grezzi"),
    "record_lines": "SELECT 'incidenti' AS entity, count(*) AS n FROM orders WHERE o_orderkey % 200 <> 3 OR o_orderkey % 500 = 499 UNION ALL SELECT 'persone', count(*) FROM lineitem",
    "json_repair": f"""SELECT 'incidenti' AS entity, ID AS chiave, Via AS uno, NaturaIncidente AS due, Gruppo AS tre FROM ({_RECORDS})
 UNION ALL {_PERSONS}""",
    "ingest_files": f"""SELECT 'incidenti' AS entity, '2014_05' AS period, ID AS chiave, Via AS uno, NaturaIncidente AS due, Gruppo AS tre FROM ({_RECORDS})
 UNION ALL SELECT entity, '2015', chiave, uno, due, tre FROM ({_PERSONS})""",
    "replaced_period": "SELECT 'persone' AS entity, '2015' AS period, count(*) AS n FROM lineitem",
    "corrupt_count": "SELECT 'incidenti' AS entity, count(*) FILTER (o_orderkey % 500 NOT IN (497, 499)) + count(*) FILTER (o_orderkey % 500 IN (496, 498)) AS good, count(*) FILTER (o_orderkey % 500 IN (497, 499)) AS corrupt FROM orders WHERE o_orderkey % 200 <> 3 OR o_orderkey % 500 = 499 UNION ALL SELECT 'persone', count(*) FILTER ((l_orderkey * 7 + l_linenumber) % 333 <> 5), count(*) FILTER ((l_orderkey * 7 + l_linenumber) % 333 = 5) FROM lineitem",
    "unrouted": "SELECT '/dati/roma_' || strftime(o_orderdate, '%Y_%m') || '/note.json' AS file_path, count(*) AS n FROM orders WHERE o_orderkey % 4 = 3 GROUP BY 1",
    "route_files": """SELECT CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE 'incidenti' END AS entity, strftime(o_orderdate, '%Y_%m') AS period, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 2 GROUP BY 1,2
 UNION ALL SELECT CASE l_linenumber WHEN 1 THEN 'persone' WHEN 2 THEN 'pedoni' WHEN 3 THEN 'veicoli' ELSE 'persone' END, NULL, count(*) FROM lineitem GROUP BY 1,2""",
    "documents_read_back": _with("SELECT * FROM fasce_ore", "quando", "ore", "fasce_ore"),
    "load_entity": _with("SELECT * EXCLUDE (Visibilita), cast(NULL AS varchar) AS Visibilita FROM incidenti"),
    "itemsets_wide_by_group": _with(f"SELECT g AS Gruppo, {_JOINED % 'items'} AS items, n FROM nove_sets JOIN (SELECT g, ceil(0.1 * count(*)) AS least FROM nove GROUP BY 1) USING (g) WHERE n >= least", "quando", "ore", "nove", "nove_n", "nove_sets"),
    "scenario_rules_by_group_support": _with(f"SELECT r.g AS Gruppo, {_JOINED % 'ante'} AS antecedent, cons AS consequent, confidence, {_SCORE} AS score FROM sc_rules r JOIN sc_sets s ON r.g=s.g AND list_sort(list_append(ante, cons))=s.items JOIN (SELECT g, ceil(0.01 * count(*)) AS least FROM sc GROUP BY 1) t ON t.g=r.g WHERE s.n >= least AND len(ante)>=2 AND NOT list_contains(ante, '')", "sc=sc_g", "sc_n", "sc_sets", "sc_pairs", "sc_rules"),
    "itemset_counts_levelwise": _with(f"SELECT {_JOINED % 'items'} AS items, n FROM sc_sets WHERE len(items)>=2 AND n >= ceil(0.02 * (SELECT count(*) FROM sc))", "sc", "sc_n", "sc_sets"),
    "times_totals": _with("SELECT Gruppo, Giorno, FasciaOraria, count(*) AS n, GROUPING(Gruppo, Giorno, FasciaOraria) AS livello FROM ore WHERE Gruppo<>'' GROUP BY ROLLUP (Gruppo, Giorno, FasciaOraria)", "quando", "ore"),
    "drivers_totals": _with("SELECT Municipio, FasciaEta, Sesso, cast(sum(n) AS bigint) AS n, GROUPING(Municipio, FasciaEta, Sesso) AS livello FROM guida GROUP BY ROLLUP (Municipio, FasciaEta, Sesso)", "guida"),
    "makes_cube": _with("SELECT Marca, TipoIncidente, FondoStradale, cast(sum(NumIncidenti) AS bigint) AS NumIncidenti, GROUPING(Marca, TipoIncidente, FondoStradale) AS livello FROM marche GROUP BY CUBE (Marca, TipoIncidente, FondoStradale)", "marche"),
    "nested_times_totals": _with("SELECT cast(to_json({'Gruppo': Gruppo, 'Totale': cast(sum(t) AS bigint), 'Info': list({'Giorno': Giorno, 'Totale': t, 'Info': i} ORDER BY Giorno)}) AS varchar) AS doc FROM (SELECT Gruppo, Giorno, cast(sum(n) AS bigint) AS t, list({'FasciaOraria': FasciaOraria, 'Count': n} ORDER BY n DESC, FasciaOraria) AS i FROM fasce_ore GROUP BY 1,2) GROUP BY Gruppo", "quando", "ore", "fasce_ore"),
    "nested_drivers_totals": _with("SELECT cast(to_json({'Municipio': Municipio, 'Totale': cast(sum(t) AS bigint), 'info': list({'FasciaEta': FasciaEta, 'Totale': t, 'Info': i} ORDER BY FasciaEta)}) AS varchar) AS doc FROM (SELECT Municipio, FasciaEta, cast(sum(n) AS bigint) AS t, list({'Sesso': Sesso, 'Count': n} ORDER BY n DESC, Sesso) AS i FROM guida GROUP BY 1,2) GROUP BY Municipio", "guida"),
    "entity_presence": _with("SELECT * FROM presenze", "presenze"),
    "entity_integrity": _with(" UNION ALL ".join([
        _entity("incidenti", "ID", "ID IS NULL OR ID NOT IN (SELECT IDProtocollo FROM persone UNION ALL SELECT IDProtocollo FROM pedoni UNION ALL SELECT IDProtocollo FROM veicoli)"),
        *[_entity(e, "IDProtocollo", "IDProtocollo IS NULL OR IDProtocollo NOT IN (SELECT ID FROM incidenti)") for e in ("persone", "pedoni", "veicoli")],
    ])),
    "orphan_persons": _with("SELECT IDProtocollo AS chiave, count(*) AS n FROM persone ANTI JOIN incidenti ON ID=IDProtocollo GROUP BY 1"),
    "childless_accidents": _with("SELECT ID AS chiave, count(*) AS n FROM incidenti ANTI JOIN pedoni ON ID=IDProtocollo GROUP BY 1"),
    "replaced_counts": _with("SELECT *, totale AS n FROM (SELECT Gruppo, TipoIncidente, cast(sum(CASE year(ts) WHEN 1994 THEN 2 ELSE 1 END) AS bigint) AS totale FROM (SELECT trim(i.Gruppo) AS Gruppo, trim(i.NaturaIncidente) AS TipoIncidente, q.ts FROM (SELECT row_number() OVER () AS r, * FROM incidenti) i JOIN (SELECT row_number() OVER () AS r, * FROM quando) q USING (r)) WHERE Gruppo<>'' AND TipoIncidente<>'' AND (ts IS NULL OR year(ts)<>1996) GROUP BY 1,2)", "quando"),
    "ingest_deliveries": " UNION ALL ".join(
        f"""SELECT 'incidenti' AS entity, '2014_0{m}' AS period, count(*) FILTER (k % 500 NOT IN (497, 499)) + count(*) FILTER (k % 500 IN (496, 498)) AS good, count(*) FILTER (k % 500 IN (497, 499)) AS corrupt FROM (SELECT o_orderkey AS k FROM orders) WHERE k % {d} = 0 AND (k % 200 <> 3 OR k % 500 = 499)"""
        for m, d in ((5, 2), (6, 3))
    ) + " UNION ALL SELECT 'persone', '2015', count(*) FILTER ((l_orderkey * 7 + l_linenumber) % 333 <> 5), count(*) FILTER ((l_orderkey * 7 + l_linenumber) % 333 = 5) FROM lineitem",
    "drivers_accidents": _with("SELECT Municipio, FasciaEta, Sesso, count(*) AS n, count(DISTINCT ID) AS NumIncidenti FROM alla_guida GROUP BY 1,2,3", "alla_guida"),
    "drivers_accidents_totals": _with("SELECT Municipio, FasciaEta, Sesso, count(*) AS n, count(DISTINCT ID) AS NumIncidenti, GROUPING(Municipio, FasciaEta, Sesso) AS livello FROM alla_guida GROUP BY ROLLUP (Municipio, FasciaEta, Sesso)", "alla_guida"),
    "makes_accidents": _with("SELECT Marca, coalesce(NaturaIncidente,'') AS TipoIncidente, count(*) AS NumVeicoli, count(DISTINCT ID) AS NumIncidenti FROM incidenti JOIN veicoli ON ID=IDProtocollo WHERE Marca<>'' GROUP BY 1,2"),
    "accidents_sketched": _with("SELECT Gruppo, count(DISTINCT ID) AS NumIncidenti FROM (SELECT trim(i.Gruppo) AS Gruppo, i.ID, trim(i.NaturaIncidente) AS t, q.ts FROM (SELECT row_number() OVER () AS r, * FROM incidenti) i JOIN (SELECT row_number() OVER () AS r, * FROM quando) q USING (r)) WHERE Gruppo<>'' AND t<>'' AND (ts IS NULL OR year(ts)<>1996) GROUP BY 1", "quando"),
    "pedestrians_and_young": _with(f"SELECT Gruppo, count(*) FILTER (p AND NOT g) AS sinistra, count(*) FILTER (g AND NOT p) AS destra, count(*) FILTER (p AND g) AS entrambi, count(*) AS unione FROM (SELECT DISTINCT Gruppo, ID, ID IN (SELECT IDProtocollo FROM pedoni) AS p, ID IN (SELECT IDProtocollo FROM persone WHERE TipoPersona='Conducente' AND {_AGE}='18-25') AS g FROM incidenti WHERE Gruppo<>'') WHERE p OR g GROUP BY 1"),
    "itemsets_closed": _with(f"SELECT {_JOINED % 's.items'} AS items, s.n, {_MARKS % ('sc_sets', 'sc_sets')} FROM sc_sets s", "sc", "sc_n", "sc_sets"),
    "itemsets_closed_by_group": _with(f"SELECT s.g AS Gruppo, {_JOINED % 's.items'} AS items, s.n, {_MARKS % ('nove_frequenti', 'nove_frequenti')} FROM nove_frequenti s", "quando", "ore", "nove", "nove_n", "nove_sets", "nove_frequenti"),
    "scenario_rules_essential": _with(f"SELECT g AS Gruppo, {_JOINED % 'ante'} AS antecedent, cons AS consequent, confidence, {_SCORE} AS score FROM sc_rules r WHERE NOT list_contains(ante, '') AND NOT EXISTS (SELECT 1 FROM sc_rules q JOIN sc_pairs a ON a.g=q.g AND a.ante=q.ante AND a.cons=q.cons JOIN sc_pairs b ON b.g=r.g AND b.ante=r.ante AND b.cons=r.cons WHERE q.g=r.g AND q.cons=r.cons AND len(q.ante)<len(r.ante) AND list_has_all(r.ante, q.ante) AND q.confidence=r.confidence AND a.n=b.n)", "sc=sc_g", "sc_n", "sc_sets", "sc_pairs", "sc_rules"),
    "rules_tested": _with(f"SELECT {_JOINED % 'ante'} AS antecedent, cons AS consequent, {_TESTED} FROM prova", "sc", "sc_n", "sc_sets", "sc_conti=conti", "prova"),
    "rules_tested_by_group": _with(f"SELECT g AS Gruppo, {_JOINED % 'ante'} AS antecedent, cons AS consequent, {_TESTED} FROM prova", "quando", "ore", "nove", "nove_n", "nove_sets", "sc_sets=nove_ventesimo", "sc_n=nove_n", "sc_conti=conti", "prova"),
    "busiest_accidents": _with("SELECT *, row_number() OVER (PARTITION BY Gruppo ORDER BY NumPersone DESC, ID) AS pos FROM (SELECT trim(Gruppo) AS Gruppo, ID, count(*) AS NumPersone FROM incidenti JOIN persone ON ID=IDProtocollo WHERE Gruppo<>'' GROUP BY 1,2) QUALIFY pos<=10"),
    "worst_days": _with("SELECT *, row_number() OVER (PARTITION BY Gruppo ORDER BY n DESC, giorno) AS pos FROM giorni QUALIFY pos<=10", "quando", "giorni"),
    "worst_days_kept": _with("SELECT *, row_number() OVER (PARTITION BY Gruppo ORDER BY n DESC, giorno) AS pos FROM giorni WHERE year(giorno)<>1996 QUALIFY pos<=10", "quando", "giorni"),
    "worst_days_overall": _with("SELECT *, row_number() OVER (ORDER BY n DESC, giorno) AS pos FROM (SELECT cast(ts AS date) AS giorno, count(*) AS n FROM quando WHERE ts IS NOT NULL GROUP BY 1) QUALIFY pos<=100", "quando"),
    "types_monthly": _with(_monthly("(SELECT min(mese) FROM mesi)", "(SELECT max(mese) FROM mesi)"), "quando", "mesi"),
    "types_monthly_period": _with(_monthly("DATE '1993-12-01'", "DATE '1996-05-01'"), "quando", "mesi"),
}
ORACLE["ingest_stream"] = ORACLE["ingest_files"]
