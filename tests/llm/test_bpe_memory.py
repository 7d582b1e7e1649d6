import public_tokenizers
import pyarrow as pa

from quillstone.llm import bpe


def test_ids_of_some_texts_are_laid_out_at_once():
    """Pipeline finding: ids and bytes of a whole part lay in memory together, and each cached word was a tuple of two strings."""
    own = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["many plain words stand here in a row " * 30 + ("\n\n  odd" if i % 7 == 0 else f"\nline {i}") for i in range(3000)]
    before, most, got = pa.total_allocated_bytes(), 0, []
    for _, plain in own.encode(texts):
        most = max(most, pa.total_allocated_bytes() - before)
        got.append(bytes(plain).decode())
    assert got == texts
    assert most < 2 * sum(map(len, texts))
    assert all(isinstance(x, bytes) for x in own.known.values())
    own.close()
