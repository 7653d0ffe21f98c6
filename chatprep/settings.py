"""Values shared by the registered queries, their SQL oracles and the tests."""

from __future__ import annotations

from dataclasses import dataclass

IGNORE_LABEL = -100
UNKNOWN = "<unk>"


@dataclass(frozen=True)
class ChatTokens:
    """Special strings of the chat template. None of them has a default on
    purpose except the image token: a wrong end token silently spoils data."""

    start: str
    end: str
    bos: str
    eos: str
    image: str = "<img>"

    @property
    def specials(self) -> list[str]:
        return [UNKNOWN, self.bos, self.eos, self.start, self.end, self.image]


TOKENS = ChatTokens("<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>")

SEED = 42
EPOCH = 0
MAX_LENGTH = 2048
PACK_LIMIT = 20
BINS = 100
BAR_WIDTH = 50
TOP_LENGTHS = 100
BATCH_SIZE = 6
MEGA_BATCHES = 50
IMAGE_SIZE = 384
PATCH_SIZE = 14

RESPONSE_TEMPLATE = ["###", "Assistant:"]
INSTRUCTION_TEMPLATE = ["###", "User:"]
