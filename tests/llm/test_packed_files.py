"""The files that write_packed writes against the rows they hold."""

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from parityframe.llm.common import stored
from parityframe.llm.packing import pack_documents, write_packed


def test_files_hold_the_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (1 + 37 * i % 211) if i % 9 else None) for i in range(60)],
                                 "doc_id long, text string").repartition(3, "doc_id")
    packed = pack_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, length=64, block_tokens=1 << 10)
    rows = {}
    for r in packed.orderBy("shard", "row").collect():
        rows.setdefault(r.shard, []).append(r)
    again = stored(packed, "again").repartition(5)       # tasks that are not the shards
    for folder, table in ((str(tmp_path / "made"), packed), (None, packed), (None, again)):
        manifest = write_packed(table, folder).collect()
        assert sorted(m.shard for m in manifest) == sorted(rows) and len(rows) > 1
        for m in manifest:
            want = rows[m.shard]
            ids, ends, resets = (np.fromfile(p, "<i4") for p in (m.ids, m.cu_seqlens, m.position_resets))
            assert (m.n_rows, m.length) == (len(want), 64) and m.n_tokens == sum(r.n_tokens for r in want)
            assert ids.tobytes() == b"".join(bytes(r.ids) for r in want) and ids.reshape(m.n_rows, m.length).shape[0] == len(want)
            assert [x.tolist() for x in np.split(ends, np.flatnonzero(ends == 0)[1:])] == [r.cu_seqlens for r in want]
            assert [x.tolist() for x in np.split(resets, np.flatnonzero(resets == 0)[1:])] == [r.position_resets for r in want]
            assert m.n_pieces == len(resets)
            assert folder is None or m.ids.startswith(folder)
    assert write_packed(packed.filter(F.lit(False))).count() == 0
