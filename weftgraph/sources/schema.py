"""Fixed schemas and limits of the graph's tables. Documents' bodies have no place in them."""

MAX_LABEL_BYTES, MAX_SEGMENTS, MAX_EDGES, MAX_SCORES = 2048, 128, 64, 128
LINK, RELATED, REDIRECT = 0, 2, 3
UNCHANGED, CHANGED, ERROR, GONE = 0, 1, 2, 3
FULL_WEIGHT, COUNTER_MAX = 65535, 65535
AUTO_COMPACT_OPS, AUTO_COMPACT_BYTES = 4096, 4 << 20

NODES = """node_key bigint, url string, title string, snippet string, etag string, content_hash bigint,
  fetched_at_ms bigint, last_change_ms bigint, interval_s bigint, checks int, changes int,
  pinned boolean, is_stub boolean, is_tombstone boolean, in_degree bigint"""
SEGMENTS = "node_key bigint, ordinal int, label string, byte_start bigint, byte_len bigint, depth int, importance int, llm_scored boolean"
EDGES = "src_key bigint, dst_key bigint, etype int, tier_enrich boolean, inferred boolean, weight int"
POSTINGS = "token string, node_key bigint"
RANKS = "node_key bigint, node_id bigint, permille int, community bigint, community_key bigint"

CORE = "struct<url:string,title:string,snippet:string,etag:string,content_hash:bigint,fetched_at_ms:bigint,pinned:boolean>"
SEGMENT_SET = "array<struct<label:string,byte_start:bigint,byte_len:bigint,depth:int,importance:int,llm_scored:boolean>>"
EDGE_SET = "array<struct<dst_key:bigint,etype:int,tier_enrich:boolean,inferred:boolean,weight:int>>"
TOUCH = "struct<fetched_at_ms:bigint,interval_s:bigint,checks:int,changes:int,last_change_ms:bigint,content_hash:bigint,etag:string,tombstone:boolean>"
SCORES = "array<struct<ordinal:int,importance:int>>"
#: One row per operation; the column of its kind is set.
OPS = f"seq bigint, op string, node_key bigint, core {CORE}, segs {SEGMENT_SET}, edges {EDGE_SET}, touch {TOUCH}, pin boolean, scores {SCORES}"
