"""Entity schemas and the fixed values the accident data is described with."""

from __future__ import annotations

from pyspark.sql import types as T


def text_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


# Every source field is text; typed values are derived by the jobs.
ENTITIES: dict[str, T.StructType] = {
    "incidenti": text_schema(
        "ID",
        "Gruppo",
        "NaturaIncidente",
        "DataOraIncidente",
        "Pavimentazione",
        "Segnaletica",
        "Illuminazione",
        "Visibilita",
        "Traffico",
        "FondoStradale",
    ),
    "persone": text_schema("IDProtocollo", "TipoPersona", "Sesso", "AnnoNascita"),
    "pedoni": text_schema("IDProtocollo"),
    "veicoli": text_schema("IDProtocollo", "Marca"),
}

BASELINE = T.StructType(
    [T.StructField("item", T.StringType(), True), T.StructField("freq", T.DoubleType(), True)]
)

CROSSWALK = T.StructType(
    [
        T.StructField("old", T.StringType(), True),
        T.StructField("new", T.StringType(), True),
        T.StructField("valid_before", T.TimestampNTZType(), True),
    ]
)

# The order in which a file name is tested for an entity.
FILE_ENTITIES = ["incidenti", "veicoli", "pedoni", "persone"]

# Raw paving labels and the class each belongs to.
PAVING_CLASSES = {
    "Asfaltata": ["Asfaltata", "In conglomerato cementizio", "Bitumata"],
    "Dissestata": ["Con buche", "Strada pavimentata dissestata"],
    "Lastricata": ["Lastricata", "In cubetti di porfido", "Acciotolata"],
    "Sterrata": ["Sterrata", "Inghiaiata", "Fondo naturale"],
}

# Weekday labels, Sunday first, and the label of an unreadable date.
WEEKDAYS = ["Domenica", "Lunedi", "Martedi", "Mercoledi", "Giovedi", "Venerdi", "Sabato"]
WEEKDAY_UNKNOWN = "non-definito"

# Fixed values: (first hour no longer in the band, label). The labels do not
# follow the bounds (07:xx-08:xx is "7-9", 20:xx is "21-24") and are kept as is.
TIME_BANDS = [(6, "0-6"), (9, "7-9"), (13, "10-13"), (17, "14-17"), (20, "18-20"), (24, "21-24")]
TIME_BAND_UNKNOWN = "non-definita"

# Fixed values: (first age no longer in the band, label). Minors fall in the
# first band and age 70 in the last.
AGE_BANDS = [(26, "18-25"), (40, "26-39"), (70, "40-69"), (100, "71-99")]
AGE_BAND_UNKNOWN = "non-identificato"
REFERENCE_YEAR = 2016

# Fixed value: the person type that counts as a driver.
DRIVER = "Conducente"
