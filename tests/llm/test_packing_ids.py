import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomlens.llm import common as C
from loomlens.llm import idfiles, packing
from loomlens.llm.tokens import ByteLevel, WordLevel

ODD = ["", " ", "\n\n  a b  c\t\n", "it's l'été don't'x", "Ünïcödé ÉCOLE ñ × ÷ …", "a b  c　 d", "x\x1cy\x0bz \x85 q", "≠ ≮ ẖ H̱ Å ΑΣ Σ", "<|endoftext|> foo<|endoftext|>bar <|startoftext|>", "12 345,67 a1b2 !!x!! ...", "日本語 テキスト 🙂🙂 é́", "word " * 3000, "'s 't '", "q́'D A'LL"]


def reference(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("kind", "name"), [(ByteLevel, packing.TOKENIZER), (WordLevel, idfiles.TOKENIZER)])
def test_units_give_the_library_s_ids(spark, kind, name):
    ids_of = kind(name)
    texts = ODD + [r.text for r in C.table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()]
    for text in texts:
        assert ids_of(text.encode()).tolist() == reference(name, text), text[:50]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start long, n long, part string").repartition(3)


def test_pieces_cover_each_id_once(spark):
    texts = [*ODD, None, "word " * 3000]
    rows = [(i, t, 1, 2, "x") for i, t in enumerate(texts)] + [(None, "no id", 0, 0, None)]
    got = packing.pack(documents(spark, rows), with_ids=True).collect()
    want = {i: reference(packing.TOKENIZER, t or "") + [1] for i, t in enumerate(texts)} | {None: reference(packing.TOKENIZER, "no id") + [1]}
    place = {}
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and list(r.ids) == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        for k in range(r.length):
            assert (r.sequence_id, r.offset + k) not in place
            place[r.sequence_id, r.offset + k] = (r.doc_id, r.start + k)
    total = sum(map(len, want.values()))
    assert sorted(place) == [divmod(k, 2048) for k in range(total)] and len(set(place.values())) == total


def test_empty_tables(spark):
    none = documents(spark, [])
    assert packing.pack(none).count() == 0 and idfiles.round_trip(none).count() == 0


def test_files_come_back(spark):
    rows = [(i - 3, t, 0, 0, "") for i, t in enumerate([*ODD, None])] + [(None, "no id", 0, 0, ""), (5, "again", 0, 0, "")]
    path = idfiles.write(documents(spark, rows), idfiles.shared_path(spark, "t"), block_ids=40)
    got = sorted(idfiles.read(spark, path).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    start = 0
    for r, (doc_id, text, *_) in zip(got, order, strict=True):
        ids = reference(idfiles.TOKENIZER, text or "") + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_export(spark, tmp_path):
    path = idfiles.write(documents(spark, [(1, "a b", 0, 0, ""), (2, "c", 0, 0, "")]), idfiles.shared_path(spark, "t"))
    assert idfiles.export(spark, path, str(tmp_path)) == len(list(tmp_path.iterdir())) > 0
    block = idfiles.Block(next(iter(sorted(tmp_path.iterdir()))).read_bytes())
    assert block.document(0).tolist()[-1] == 2


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [5, 5, 1000, 10**12], list(range(0, 5000, 7)), [2**40] * 300])
def test_elias_fano(values):
    made = idfiles.EliasFano.of(np.array(values))
    loaded, _ = idfiles.EliasFano.load(b"xx" + made.dump(), 2)
    assert loaded.all().tolist() == values and [loaded.select(i) for i in range(len(values))] == values
