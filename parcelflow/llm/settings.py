"""Where the vocabulary files lie: those of the installed package, or of the folder PARCELFLOW_TOKENIZERS names."""

from __future__ import annotations

import os


def vocabulary(file: str) -> str:
    folder = os.environ.get("PARCELFLOW_TOKENIZERS")
    if folder:
        return f"{folder}/{file}"
    import public_tokenizers

    return public_tokenizers.path(file)


TOKENIZERS = {"word_bpe_49k": vocabulary("word_bpe_49k.json")}
