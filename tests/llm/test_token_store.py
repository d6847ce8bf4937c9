import io
import struct

import numpy as np
import public_tokenizers as P
import pytest
import zstandard
from tokenizers import Tokenizer

from veilspan.llm import token_store as S

PATH = P.path("byte_bpe_50k.json")


def raw(*ids):
    return np.array(ids, "<u4").tobytes()


def written(documents):
    sink = io.BytesIO()
    writer = S.Writer(sink)
    for doc_id, ids in documents:
        writer.add(doc_id, ids)
    writer.close()
    return sink


def test_round_trip_and_lookup():
    big = np.arange(S.FRAME_IDS + 5, dtype="<u4")
    documents = [(None, raw(1, 2)), (-5, raw()), (7, raw(9)), (7, big.tobytes())]
    sink = written(documents)
    reader = S.Reader(sink)
    assert reader.ids == [None, -5, 7, 7]
    assert [reader.document(i).tobytes() for i in range(4)] == [x for _, x in documents]
    # Any zstandard reader sees the frames one after another.
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(x for _, x in documents)


def test_damage_is_found():
    good = written([(1, raw(*range(100))), (2, raw(5))]).getvalue()
    for broken in (good[:-1], good[:30], good[:-9] + struct.pack("<IBI", 2, 0, S.SEEK_END)):
        with pytest.raises(S.StoreError):
            S.Reader(io.BytesIO(broken))
    reader = S.Reader(io.BytesIO(good))
    reader.frames = reader.frames.copy()
    reader.frames[0, 2] ^= 1
    with pytest.raises(S.StoreError):
        reader.document(0)
    assert reader.document(1).tolist() == [5]


def test_only_requested_frames_are_read():
    class Counting(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            out = super().read(n)
            self.read_bytes += len(out)
            return out

    noise = np.random.default_rng(1).integers(0, 50_000, 20_000, dtype=np.uint32).astype("<u4").tobytes()
    source = Counting(written([(i, noise) for i in range(20)]).getvalue())
    reader = S.Reader(source)
    before = source.read_bytes
    reader.document(11)
    assert source.read_bytes - before < len(source.getvalue()) / 15


def test_as_the_library():
    own, library = S.LibraryEncoder(PATH), Tokenizer.from_file(PATH)
    texts = ["", " ", "a  b", "x <|endoftext|> y", "a\n b", "'s 're", "日本 é", " a b c", None, "\0 a"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_table(spark, awkward, extra, empty):
    library = Tokenizer.from_file(PATH)
    rows = sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    want, start = [], 0
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, raw(*ids)))
        start += len(ids)
    found = [(r.doc_id, r.start, bytes(r.ids)) for r in S.store_and_read(extra.repartition(3), PATH).orderBy("start").collect()]
    assert found == want
    assert S.store_and_read(empty, PATH).collect() == []
    folder = S.new_folder(spark)
    manifest = S.write(awkward, PATH, folder).collect()
    assert sum(r.n_docs for r in manifest) == 10
    first = manifest[0]
    assert S.lookup(folder, first.path, [0])[0].tobytes() == want[0][2]


def test_ids_that_the_file_cannot_hold(spark):
    for value, kind in (("a", "string"), (-(1 << 63), "long")):
        with pytest.raises(Exception, match="whole numbers|stands for a null"):
            S.store_and_read(spark.createDataFrame([(value, "x")], f"doc_id {kind}, text string"), P.path("byte_bpe_50k.json")).collect()


def test_batches_are_bounded():
    class Stub:
        ids = list(range(40))

        def document(self, number):
            return np.full(S.CHUNK_CHARS // 10 if number < 30 else 1, number, np.uint32)

    sizes = [[len(x) for x in batch.column(2).to_pylist()] for batch in S.batches(Stub(), 5)]
    assert sum(map(len, sizes)) == 40 and max(map(sum, sizes)) <= 1.5 * S.CHUNK_CHARS
