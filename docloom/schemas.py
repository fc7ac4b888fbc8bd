"""Types that the frames share.

elements: source_identifier, element_index, el_type ("text", "table", "figure"), text, rows (of a table), xpath, coordinates, other_info.
"""

CELL = "struct<val:string,colspan:int>"
ROWS = f"array<struct<row_type:string,values:array<{CELL}>>>"
COORDINATES = "struct<x0:double,x1:double,y0:double,y1:double>"
OTHER_INFO = "struct<page_idx:int,page_size:array<double>>"
SOURCE = f"struct<source_type:string,coordinates:{COORDINATES},xpath:string,element_index:int,other_info:{OTHER_INFO}>"
ELEMENT = f"struct<el_type:string,source:{SOURCE},text:string,source_id:string,rows:{ROWS}>"
DOCUMENT = f"struct<source_type:string,source_identifier:string,elements:array<{ELEMENT}>>"
META = "struct<class_id:string,class_value:string,prob:double>"
PAIRS = "array<struct<line_item:string,value:decimal(38,10)>>"

DOC_TYPES = ("text", "pdf", "html", "tabular", "other")
TYPES = ("list", "multi", "int", "text", "numeric", "percentage", "entity", "date")
NOT_SPECIFIED, NOT_CONFIGURED = "[NOT_SPECIFIED]", "[NOT_CONFIGURED]"

#: Detection: probabilities and distances in characters.
MERGE_PROB, MERGE_PARTIAL, BETWEEN_PROB = 0.6, 0.1, 0.7
MERGE_DISTANCE = CLOSE_DISTANCE = 1000
UNIQUE_DISTANCE = 20000
WORDS_AROUND, TABLES_AROUND = 50, 3
#: Retrieval and prompts.
CHUNK_CHARS, TOP_K, PROMPT_TOKENS = 1000, 100, 4000
MAX_ELEMENTS, MAX_IMAGES = 10_000, 30
