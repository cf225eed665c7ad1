"""Schemas of the star schema and of the staging tables."""

from __future__ import annotations

DIM_TIME = "time_id long, date date, unix_ts long, week int, month int, year int, is_business_day boolean"
DIM_ENTITY = "entity_id long, name string, ticker string, entity_type string, industry string"
DIM_SOURCE = "source_id int, source_name string, source_type string"
FACT_HYPE = "time_id long, entity_id long, source_id int, signal_type string, metric_name string, metric_value double, raw_text string, url string"
FACT_REALITY = "time_id long, entity_id long, metric_name string, metric_value double, metric_unit string, provenance string"
ALERTS = (
    "timestamp timestamp, entity_id long, alert_level string, divergence_score double, acceleration_score double, pattern_score double, confidence double, "
    "contributing_factors struct<divergence:double,acceleration:double,pattern_similarity:double>"
)

STAR = {"dim_time": DIM_TIME, "dim_entity": DIM_ENTITY, "dim_source": DIM_SOURCE, "fact_hype_signals": FACT_HYPE, "fact_reality_signals": FACT_REALITY, "bubble_alerts": ALERTS}

#: The seeded sources, in order.
SOURCES = [("reddit", "social"), ("news", "media"), ("github", "repository"), ("huggingface", "model_hub"), ("arxiv", "research"), ("yfinance", "market"), ("sec", "regulatory")]
