"""Schemas of the stored tables."""

from __future__ import annotations

RAW = "text string, rating double, title string, parent_asin string"
REVIEW = "review_id string, text string, rating int, title string, product_id string"
TOKENIZED = REVIEW + ", sentences string, sentence_count int"
LABELED = TOKENIZED + ", topic_label string, confidence_score int, matched_keywords string"
CURATED = ("review_id string, text string, rating int, title string, product_id string, auto_topic string, "
           "confidence_score int, matched_keywords string, verified_topic string, notes string")
VERDICT = "index bigint, verified_topic string"
METADATA = ("model string, trained_at timestamp, data_source string, corpus_size bigint, "
            "params map<string,string>, metrics map<string,string>")
REPORT = ("report_ts timestamp, dataset string, review_count bigint, kind string, name string, query string, "
          "item string, passed boolean, reasoning string, details map<string,string>")
