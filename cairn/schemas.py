"""Schemas of stored tables."""
from pyspark.sql import types as T

#: as the scan returns them; ids and times are stored unsigned and cast by the scan
TRAJECTORY = T.StructType([
    T.StructField("theorem_name", T.StringType()), T.StructField("state_id", T.LongType()), T.StructField("state_pp", T.StringType()),
    T.StructField("tactic_applied", T.StringType()), T.StructField("parent_state_id", T.LongType()), T.StructField("label", T.StringType()),
    T.StructField("depth_from_root", T.IntegerType()), T.StructField("remaining_depth", T.IntegerType()),
    T.StructField("llm_log_prob", T.DoubleType()), T.StructField("ebm_score", T.DoubleType()), T.StructField("is_proof_complete", T.BooleanType()),
    T.StructField("timestamp_ms", T.LongType()), T.StructField("q_value", T.DoubleType()), T.StructField("visits", T.LongType()),
])
OPTIONAL = {"q_value": 0.0, "visits": 0}
EMBEDDINGS = T.StructType([T.StructField("state_pp", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
TACTIC_PAIRS = T.StructType([
    T.StructField("theorem", T.StringType()), T.StructField("state", T.StringType()), T.StructField("tactic", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("source", T.StringType()), T.StructField("num_goals", T.IntegerType()), T.StructField("repo", T.StringType()),
])
THEOREM_INDEX = T.StructType([T.StructField("theorems", T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("statement", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("line_number", T.IntegerType())])))])
EVALUATION = T.StructType([
    T.StructField("iteration", T.IntegerType()), T.StructField("timestamp", T.StringType()), T.StructField("llm_path", T.StringType()), T.StructField("benchmark", T.StringType()),
    T.StructField("total_theorems", T.LongType()), T.StructField("solved", T.LongType()), T.StructField("total", T.LongType()), T.StructField("rate", T.DoubleType()),
    T.StructField("avg_nodes", T.DoubleType()), T.StructField("avg_time_secs", T.DoubleType()), T.StructField("median_time_secs", T.DoubleType()),
    T.StructField("per_theorem", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("proved", T.BooleanType()), T.StructField("nodes_used", T.LongType()),
        T.StructField("time_secs", T.DoubleType()), T.StructField("failure_reason", T.StringType())]))),
])
COMPILE_RESULTS = T.StructType([T.StructField("completed", T.MapType(T.StringType(), T.StructType([T.StructField("status", T.StringType()), T.StructField("module", T.StringType())])))])
