"""Small records for the store's tests."""

DOC = "url string, node_key bigint, content_hash bigint, fetched_at_ms bigint, title string, snippet string, etag string, pinned boolean"
SEG = "node_key bigint, ordinal int, label string, byte_start bigint, byte_len bigint, depth int, importance int"
EDGE = "src_key bigint, pos int, dst_key bigint, etype int, weight int"
TOUCH = "node_key bigint, checked_at_ms bigint, outcome int, content_hash bigint, etag string"


def doc(spark, *rows):
    """rows: (key, url, hash) with optional title, snippet, pinned, fetched, etag."""
    full = []
    for r in rows:
        key, url, hash_, title, snippet, pinned, fetched, etag = (*r, *(None, None, False, 1_000_000, "v1")[len(r) - 3 :])
        full.append((url, key, hash_, fetched, title, snippet, etag, pinned))
    return spark.createDataFrame(full, DOC)


def edges(spark, *rows):
    return spark.createDataFrame([(s, p, d, t, w) for p, (s, d, t, w) in enumerate(rows)], EDGE)


def touches(spark, *rows):
    return spark.createDataFrame([(k, at, outcome, None, None) for k, at, outcome in rows], TOUCH)


def site(spark, store):
    """Three pages, two of them with headings, that link to each other and to one unknown page."""
    docs = doc(
        spark,
        (1, "https://manual.loom.test/start", 11, "First steps", "How to setup a loom and its shuttle"),
        (2, "https://manual.loom.test/calls", 12, "Calls", "What each pedal of the loom does"),
        (3, "https://manual.loom.test/doubts", 13, "Doubts", "What weavers often ask"),
    )
    segs = spark.createDataFrame(
        [(1, 0, "Setup > Upright frame", 0, 100, 1, 52000), (1, 1, "Setup > Table frame", 0, 100, 2, 31000), (2, 0, "Pedals", 0, 100, 1, 44000), (2, 1, "Heddles", 0, 100, 1, 47000)], SEG
    )
    links = edges(spark, (1, 2, 0, 65535), (1, 3, 0, 65535), (2, 1, 0, 65535), (3, 1, 0, 65535), (3, 99, 0, 65535))
    store.writer().upsert_nodes(docs).set_segments(segs).set_edges(links).commit()
