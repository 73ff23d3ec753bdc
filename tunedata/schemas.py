"""Record schemas of the data model as Spark ``StructType``s.

JSON-in-text columns of the reference (tags, hyperparameters, metrics,
status) are native arrays, maps and structs here; ``from_json`` with these
schemas converts at the boundary.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _f(name: str, typ: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, typ, nullable)


INSTRUCTION_RECORD = T.StructType([_f("instruction", S, False), _f("input", S), _f("output", S, False)])

CHAT_MESSAGE = T.StructType([_f("role", S), _f("content", S)])
CHAT_RECORD = T.StructType([_f("messages", T.ArrayType(CHAT_MESSAGE))])

TOKENIZED_RECORD = T.StructType([_f(c, T.ArrayType(T.IntegerType())) for c in
                                 ("input_ids", "attention_mask", "labels")])

VALIDATION_ISSUE = T.StructType([_f("severity", S, False), _f("message", S, False), _f("affected_field", S)])
VALIDATION_REPORT = T.StructType([_f("is_valid", B, False), _f("issues", T.ArrayType(VALIDATION_ISSUE))])

DATASET_PROFILE = T.StructType([
    _f("rows_count", L), _f("columns", T.ArrayType(S)), _f("duplicate_count", L),
    _f("missing_values", T.MapType(S, L)), _f("avg_prompt_length", D), _f("avg_response_length", D),
    _f("estimated_tokens", L)])

SPLIT_CONFIG = T.StructType([_f("train_ratio", D), _f("val_ratio", D), _f("test_ratio", D), _f("random_seed", L)])

DATASET_METADATA = T.StructType([
    _f("dataset_id", S, False), _f("dataset_name", S), _f("raw_path", S), _f("processed_path", S),
    _f("lifecycle_state", S), _f("version", L), _f("source", S), _f("created_at", TS),
    _f("profile", DATASET_PROFILE), _f("validation_report", VALIDATION_REPORT), _f("split_config", SPLIT_CONFIG)])

METRIC_SUMMARY = T.StructType([_f(m, D) for m in
                               ("bleu", "rouge_l", "bert_score", "accuracy", "precision", "recall", "f1_score")])

EVALUATION_RESULT = T.StructType([
    _f("evaluation_id", S, False), _f("model_id", S), _f("dataset_id", S), _f("task_type", S),
    _f("metrics", METRIC_SUMMARY), _f("runtime_seconds", D), _f("report_path", S), _f("created_at", TS),
    _f("latency_ms", D), _f("throughput_tps", D), _f("cost_per_1m_tokens", D)])

BENCHMARK_RESULT = T.StructType([
    _f("models", T.ArrayType(S)), _f("dataset", S), _f("latency_ms", T.MapType(S, D)),
    _f("throughput_tps", T.MapType(S, D)), _f("peak_memory_mb", T.MapType(S, D)),
    _f("cost_per_1m_tokens", T.MapType(S, D))])

TRAINING_JOB_STATUS = T.StructType([
    _f("job_id", S, False), _f("state", S), _f("current_epoch", D), _f("current_step", L), _f("total_steps", L),
    _f("train_loss", D), _f("eval_loss", D), _f("elapsed_seconds", D), _f("checkpoint_path", S),
    _f("error_message", S), _f("created_at", TS)])

REGISTRY_ENTRY = T.StructType([
    _f("checkpoint_id", S, False), _f("model_name", S), _f("base_model", S), _f("path", S),
    _f("tags", T.ArrayType(S)), _f("hyperparameters", T.MapType(S, S)), _f("registered_at", TS)])

EXPERIMENT_METADATA = T.StructType([
    _f("experiment_id", S, False), _f("run_id", S), _f("name", S), _f("status", S),
    _f("parameters", T.MapType(S, S)), _f("metrics", T.MapType(S, D)), _f("created_at", TS),
    _f("completed_at", TS)])

METRIC_HISTORY_ENTRY = T.StructType([
    _f("step", L), _f("epoch", D), _f("timestamp", TS), _f("loss", D), _f("eval_loss", D), _f("learning_rate", D)])

PREDICTION_ROW = T.StructType([
    _f("prompt", S), _f("ground_truth", S), _f("prediction", S), _f("latency_ms", D), _f("tokens_generated", L),
    _f("rouge1", D), _f("rouge2", D), _f("rougeL", D), _f("exact_match", D)])
