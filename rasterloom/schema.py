"""The fixed schemas of the engine."""

from pyspark.sql import types as T

IMAGES = "image_id bigint, name string, width int, height int, data binary"
PIXELS = "image_id bigint, x int, y int, r int, g int, b int, a int"
MASK = "image_id bigint, x int, y int, m int"
FINISH = "struct<solid_edges:boolean,alpha_threshold:int,choke:int,despill:boolean>"
PARAMS = f"struct<color:string,tolerance:double,strategy:string,edge_feather:double,finish:{FINISH}>"
PRESETS = f"ordinal int, id string, name string, icon string, description string, params {PARAMS}, custom boolean, created_at string, notes string"
TEXT_LAYER = "id string, text string, font_id string, weight int, italic boolean, size double, color string, align string, x double, y double, rotation double, letter_spacing double"

POINTS = T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))
