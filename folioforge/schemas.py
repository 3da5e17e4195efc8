"""Explicit schemas of every record of the engine; nothing is inferred."""

from __future__ import annotations

CORPUS = "id string, text string, is_vertical boolean, num_columns int"
CORPUS_TEST = "id string, passage string, is_vertical boolean, num_columns int"
ELEMENT = "type:string,content:string,src:string,caption:string,span_all:boolean,text_index:int"
ELEMENTS = f"id string, title string, elements array<struct<{ELEMENT}>>, is_vertical boolean, column_count int"
MATCH = "image_index int, text_index int, distance double"
MESSAGES = "array<struct<role:string,content:string>>"
SIDE_TEXT = "key string, value string"
IMAGE_SIZES = "src string, width int, height int"
BOX = "x:double,y:double,width:double,height:double,text:string"
BOXES = "id string, element_id string, kind string, ord int, x double, y double, width double, height double, text string"
STYLE = (
    "is_vertical:boolean,column_count:int,font:string,font_family:string,bg_color:string,figure_bg_color:string,text_color:string,show_title:boolean,"
    "rule_width:int,rule_color:string,rule_style:string,padding:int,column_gap:int,base_font_size:int,line_height:double,"
    "h1_decoration:string,h1_style:string,h1_width:int,image_alignment:string,max_img_limit:int,viewport_width:int,viewport_height:int"
)
LABEL_ELEMENT = f"{ELEMENT},bboxes:array<struct<{BOX}>>,char_bboxes:array<struct<{BOX}>>"
LABELS = f"id string, style struct<{STYLE}>, title string, title_bboxes array<struct<{BOX}>>, title_char_bboxes array<struct<{BOX}>>, elements array<struct<{LABEL_ELEMENT}>>"
GRADIENT = "applied:boolean,limit:double,flipped:boolean"
NOISE_CONFIG = (
    "background_color:array<int>,paper_texture:struct<intensity:double,seed:bigint>,rotation:struct<angle:double,bg_color:array<int>>,"
    "perspective_transform:struct<magnitude:int,deltas:array<array<int>>,bg_color:array<int>>,"
    f"lighting_gradient:struct<horizontal_gradient:struct<{GRADIENT}>,vertical_gradient:struct<{GRADIENT}>,vignette:struct<applied:boolean,center:array<int>,strength:double>>,"
    "blur:struct<applied:boolean>"
)
NOISE_LOG = f"original_file string, config struct<{NOISE_CONFIG}>"
PUBLISHED = "id string, image binary, question string, text string, is_vertical boolean, num_columns int, noise_type int"
PUBLISHED_API = "id string, image binary, question string, text string, is_vertical boolean, num_columns int"
API_REQUEST = "key string, request struct<contents:array<struct<parts:array<struct<text:string>>>>,generation_config:struct<responseModalities:array<string>>>"
API_RESPONSE = "key string, error string, response struct<candidates:array<struct<content:struct<parts:array<struct<text:string,inlineData:struct<mimeType:string,data:string>>>>>>>"
JOB = "name string, state string"
TOKENS = "id string, input_ids array<int>"
PREDICTION = "id string, pred string"
