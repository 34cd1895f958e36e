"""Public vocabulary files. They stay where they are; their path is a parameter."""

from __future__ import annotations

DEFAULT = "/opt/tokenizers/piece_bpe_32k.model"
#: The mark that a SentencePiece vocabulary has for a space.
SPACE = "▁"


def read_pieces(path: str = DEFAULT) -> list[tuple[str, str, int]]:
    """(piece, kind, id) for all ids of a SentencePiece model; kind: piece, byte, or other."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece"
    return [(model.id_to_piece(i), kind(i), i) for i in range(model.get_piece_size())]
