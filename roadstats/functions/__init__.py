from roadstats.functions.scalars import (
    age_band,
    birth_year,
    driver_age_band,
    entity_key,
    is_filled,
    java_trim,
    parse_when,
    paving_class,
    paving_class_or_upper,
    time_band,
    weekday_label,
)

__all__ = [
    "age_band",
    "birth_year",
    "driver_age_band",
    "entity_key",
    "is_filled",
    "java_trim",
    "parse_when",
    "paving_class",
    "paving_class_or_upper",
    "time_band",
    "weekday_label",
]
