"""Schemas of the domain's tables, for readers and empty tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SESSIONS = "session_id string, public_token string, client_reference string, application_id string, policy_id string, locale string, status string, reason_code string, created_at timestamp, updated_at timestamp, expires_at timestamp, version long, webhook_queued_at timestamp, webhook_delivered_at timestamp"
DOCUMENTS = "session_id string, kind string, pos int, status string, confirmed boolean, submissions long, attempts long, blocking boolean"
CAPTURES = "session_id string, kind string, side string, capture_id string, token string, object_key string, ocr_object_key string, created_at timestamp"
SIDE_RESULTS = "session_id string, kind string, side string, capture_id string, state string, leased_at_ms long, failures int, response string"
READINGS = "session_id string, kind string, side string, field string, value string"
CHECKS = "session_id string, check_id string, field string, outcome string"
QUALITY_CHECKS = "capture_id string, pos int, key string, passed boolean, status string, value string, hint string"
APPLICATIONS = "id string, name string, enabled boolean, version long, mode string, documents array<string>, required array<string>, count int, webhook_url string, webhook_secret string, return_url string, legacy string, created_at string, updated_at string"
API_KEYS = "id string, application_id string, name string, digest string, prefix string, created_at string, expires_at string, revoked_at string, last_used_at string"
EVENTS = "session_id string, seq long, type string, kind string, side string, capture_id string, mutation_key string, ok boolean, at_ms long"
TEMPLATE_KEYPOINTS = "template_id string, idx int, x double, y double, descriptor binary"
IMAGES = "image_id string, width int, height int, rgba binary"
BENCHMARK_CASES = "id string, expected string, passed boolean, failed_checks array<string>, quality_ms long, original_ocr struct<correct:long,total:long,duration_ms:long,error:boolean>, prepared_ocr struct<correct:long,total:long,duration_ms:long,error:boolean>"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
