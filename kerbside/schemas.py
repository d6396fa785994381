"""The tables that the engine works on, as explicit schemas."""

from pyspark.sql import types as T

DETECTIONS = (
    "channel_id long, frame long, pts_ms long, track_id long, class_name string, x long, y long, w long, h long,"
    " confidence double, cx long, cy long, det_ord long"
)
ARMS = "site_id string, arm_id string, arm_ord int, label string, x1 double, y1 double, x2 double, y2 double, junction_side string"
POINT = "struct<x:double,y:double>"
SITE_DOCUMENT = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("roi_polygon", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("entry_exit_lines", T.MapType(T.StringType(), T.StructType([
        T.StructField("label", T.StringType()),
        T.StructField("start", T.ArrayType(T.DoubleType())),
        T.StructField("end", T.ArrayType(T.DoubleType())),
        T.StructField("junction_side", T.StringType()),
    ]))),
])
PREDICTIONS = (
    "teacher string, site string, stem string, image_hw array<int>, boxes_xywhn array<array<double>>,"
    " confs array<double>, class_ids array<int>, inference_ms double"
)
ALERTS = (
    "channel_id long, lineage_id long, track_id string, type string, class_name string, entry_arm string, exit_arm string,"
    " method string, was_stagnant boolean, frame long, first_seen_frame long, last_seen_frame long, duration_ms long,"
    " stationary_ms long, x long, y long"
)
FATES = "channel_id long, seg_id long, lineage_id long, prev_seg long, distance double, gap_frames long, lost_frame long, final_frame long"
