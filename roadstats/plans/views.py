"""Accident-shaped views over the test tables.

One SQL text per view serves Spark and the oracle. The views include blanks,
trailing blanks, NULLs, unknown paving, date-only and unreadable times, hour 24,
blanks inside dates, blank, unreadable and very long birth years, one
municipality without traffic values, a protocol number that many accidents
share, values with underscores, equal values in two fields of a scenario, and
raw lines with two records or with text after the record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEW_SQL = {
    "incidenti": """
SELECT cast(CASE WHEN o_orderkey % 127 = 0 THEN 1 ELSE o_orderkey END AS string) AS ID,
 CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN '' ELSE cast(o_custkey % 15 + 1 AS string) || CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE '' END END AS Gruppo,
 CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE o_orderpriority END AS NaturaIncidente,
 CASE o_orderkey % 13 WHEN 0 THEN 'Asfaltata' WHEN 1 THEN 'In conglomerato cementizio' WHEN 2 THEN 'Bitumata' WHEN 3 THEN 'Con buche' WHEN 4 THEN 'Strada pavimentata dissestata' WHEN 5 THEN 'Lastricata' WHEN 6 THEN 'In cubetti di porfido' WHEN 7 THEN 'Acciotolata' WHEN 8 THEN 'Sterrata' WHEN 9 THEN 'Inghiaiata' WHEN 10 THEN 'Fondo naturale' WHEN 11 THEN 'altro' ELSE '' END AS Pavimentazione,
 CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'seg_ ' || o_orderstatus END AS Segnaletica,
 CASE WHEN o_orderkey % 79 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN 'ALTRO' ELSE 'ill ' || cast(o_custkey % 4 AS string) END AS Illuminazione,
 CASE WHEN o_custkey % 10 = 0 THEN '' ELSE 'vis ' || cast(o_custkey % 3 AS string) END AS Visibilita,
 CASE WHEN o_custkey % 15 = 14 THEN '' ELSE 'traf ' || cast(o_orderkey % 3 AS string) END AS Traffico,
 'fondo ' || cast(o_orderkey % 5 AS string) AS FondoStradale,
 CASE WHEN o_orderkey % 101 = 0 THEN 'n.d.' WHEN o_orderkey % 73 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 107 = 0 THEN ' 00' ELSE '' END || lpad(cast(day(o_orderdate) AS string),2,'0') || CASE WHEN o_orderkey % 107 = 0 THEN '/ ' ELSE '/' END || lpad(cast(month(o_orderdate) AS string),2,'0') || '/' || cast(year(o_orderdate) AS string) ||
   CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE CASE WHEN o_orderkey % 7 = 3 THEN '  ' ELSE ' ' END || lpad(cast(o_orderkey % 25 AS string),2,'0') || ':30:00' END END AS DataOraIncidente
FROM {orders}""",
    "persone": """
SELECT cast(l_orderkey AS string) AS IDProtocollo,
 CASE l_returnflag WHEN 'R' THEN 'Passeggero' ELSE 'Conducente' END AS TipoPersona,
 CASE WHEN l_partkey % 61 = 0 THEN NULL WHEN l_partkey % 50 = 0 THEN '' WHEN l_linestatus = 'F' THEN 'F' ELSE 'M' END AS Sesso,
 CASE WHEN l_suppkey % 20 = 0 THEN '' WHEN l_partkey % 67 = 0 THEN NULL WHEN l_partkey % 71 = 0 THEN 'n.d.' WHEN l_partkey % 73 = 0 THEN '0000001980' WHEN l_partkey % 79 = 0 THEN '2000000000' WHEN l_partkey % 83 = 0 THEN '99999999999' WHEN l_partkey % 89 = 0 THEN '+1975' ELSE cast(1910 + l_partkey % 95 AS string) END AS AnnoNascita
FROM {lineitem}""",
    "veicoli": """
SELECT cast(l_orderkey AS string) AS IDProtocollo, p_brand AS Marca
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "pedoni": """
SELECT cast(l_orderkey AS string) AS IDProtocollo FROM {lineitem} WHERE l_returnflag = 'N'""",
    # Malformed raw lines as they come from the files, with the file they are in.
    # Every 12th record has a stray quote pattern of its own; one line in 500 is
    # cut off and one in 200 opens an array; two in 500 hold two records and one in
    # 500 has text after its record.
    "grezzi": """
SELECT 'incidenti' AS entity, o_orderkey AS k,
 CASE WHEN o_orderkey % 500 = 499 THEN '{{"ID":"' || cast(o_orderkey AS string) || '","Via":"tro'
  WHEN o_orderkey % 500 = 498 THEN '{{"ID":"' || cast(o_orderkey AS string) || '","Via":"UNO"}},{{"ID":"-' || cast(o_orderkey AS string) || '","Via":"DUE"}},'
  WHEN o_orderkey % 500 = 496 THEN '[{{"ID":"' || cast(o_orderkey AS string) || '","Via":"UNO"}}{{"ID":"-' || cast(o_orderkey AS string) || '","Via":"DUE"}}]'
  WHEN o_orderkey % 500 = 497 THEN '{{"ID":"' || cast(o_orderkey AS string) || '"}} e altro'
  WHEN o_orderkey % 200 = 3 THEN '{{"Incidenti":['
  ELSE '  {{"ID":"' || cast(o_orderkey AS string) || '","Via":"' ||
   CASE o_orderkey % 12 WHEN 1 THEN 'ROMA "CENTRO" NORD' WHEN 2 THEN 'ROMA, "CENTRO", NORD' WHEN 3 THEN 'a "b" c" d' WHEN 4 THEN 'a' || chr(92) || 'b' WHEN 5 THEN '"' WHEN 6 THEN '"x" "y" "z" w' ELSE 'VIA ' || o_orderstatus END ||
   '","NaturaIncidente":"' || o_orderpriority || '","Gruppo":"' || cast(o_custkey % 15 + 1 AS string) || '"}},' END AS value,
 '/dati/roma_' || cast(year(o_orderdate) AS string) || '_' || lpad(cast(month(o_orderdate) AS string),2,'0') || CASE o_orderkey % 4 WHEN 0 THEN '/Incidenti.json' WHEN 1 THEN '/INCIDENTI_1.txt' WHEN 2 THEN '/incidenti.csv' ELSE '/note.json' END AS file_path
FROM {orders}
UNION ALL
SELECT 'persone' AS entity, l_orderkey AS k,
 CASE WHEN (l_orderkey * 7 + l_linenumber) % 333 = 5 THEN '{{"IDProtocollo":"9' ELSE '{{"IDProtocollo":"' || cast(l_orderkey AS string) || '","Sesso":"' || l_linestatus || '","Nome":"ANNA "' || l_returnflag || '" ROSSI"}},' END AS value,
 '/dati/roma/' || CASE l_linenumber WHEN 1 THEN 'Persone.json' WHEN 2 THEN 'pedoni_persone.txt' WHEN 3 THEN 'Veicoli.json' ELSE 'persone.jsonl' END AS file_path
FROM {lineitem}""",
    # Old division to new, with the day up to which the old one was in use.
    "crosswalk": """
SELECT cast(n_nationkey + 1 AS string) AS old, 'M' || cast(n_nationkey % 7 + 1 AS string) AS new, cast('1998-03-01 00:00:00' AS {ntz}) AS valid_before
FROM {nation} WHERE n_nationkey < 19 AND n_nationkey % 4 <> 1
UNION ALL SELECT cast(n_nationkey + 1 AS string), 'V' || cast(n_nationkey % 3 AS string), cast('1995-06-01 00:00:00' AS {ntz}) FROM {nation} WHERE n_nationkey % 5 = 2""",
}

_TABLES = ["orders", "lineitem", "part", "nation"]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; a query reads only the columns it uses."""
    text = VIEW_SQL[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{%s}" % t in text}
    return spark.sql(text.replace("{ntz}", "timestamp_ntz"), **used)


def oracle_view(name: str) -> str:
    """A view's text for the oracle, which knows the tables by name."""
    return VIEW_SQL[name].format(**{t: t for t in _TABLES}, ntz="timestamp")
