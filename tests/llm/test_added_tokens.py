import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from washline.llm.common import text_buffer
from washline.llm.packing import encoder, pack
from washline.llm.queries import tokenizer_path

END = "<|endoftext|>"
PARTS = [END, END[:5], END[5:], "<|", "|>", "a", "be", " ", "  ", "\n", ".", "9", "é", "'s", "<pad it>", "<w>", "<l>", "<r>"]


def ids_of(texts, path):
    """Ids by the tokenizer as its file has it."""
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def more_tokens(tmp_path):
    """The tokenizer with added tokens that hold a blank or look at what is beside them."""
    with open(tokenizer_path()) as f:
        data = json.load(f)
    plain = data["added_tokens"][0]
    for k, (text, how) in enumerate([("<pad it>", {}), ("<w>", {"single_word": True}), ("<l>", {"lstrip": True}), ("<r>", {"rstrip": True, "special": False})]):
        data["added_tokens"].append({**plain, "id": plain["id"] + 1 + k, "content": text, **how})
    path = tmp_path / "tokens.json"
    path.write_text(json.dumps(data))
    return str(path)


@pytest.mark.parametrize("added", [False, True])
def test_ids_are_those_of_the_unchanged_tokenizer(tmp_path, added):
    path = more_tokens(tmp_path) if added else tokenizer_path()
    rng = random.Random(5)
    texts = ["", END, f"a{END}b", f"x {END} y", END * 3, f"t{END[:6]}", END[6:]]
    texts += ["".join(rng.choices(PARTS, k=rng.randint(1, 12))) for _ in range(3000)]
    ids, bounds = encoder(path).encode(*text_buffer(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == ids_of(texts, path)


def test_pack_gives_the_ids_of_the_contract(documents):
    rows = [(1, f"a{END}b", "en", "x"), (2, "hello world", "en", "x"), (3, END, "en", "y")]
    wanted = {r[0]: [*ids, 1] for r, ids in zip(rows, ids_of([r[1] for r in rows], tokenizer_path()))}
    assert wanted[1] == [64, 50256, 65, 1]
    found = pack(documents(rows), tokenizer_path(), keep_ids=True).collect()
    got = {i: sum((p.ids for p in sorted(found, key=lambda p: p.start) if p.doc_id == i), []) for i in wanted}
    assert got == wanted
    for p in found:
        part = wanted[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(wanted[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
