"""Fixed values of the digest format."""

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: The same 64 places in ascending ASCII order: strings translated to it compare as block hashes do.
ORDERED = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz~"
MIN_BLOCK_SIZE = 3
BLOCK_SIZES = 31
FULL_SIZE, HALF_SIZE = 64, 32
MAX_RUN = 3
WINDOW = 7
ROLL_WINDOW, ROLL_SHIFT = 7, 5
FNV_START, FNV_FACTOR = 0x27, 0x01000193 % 64
MAX_INPUT_SIZE = 192 << 30
MIN_RECOMMENDED_INPUT_SIZE = 4097
CAPPING_BORDER = 4
MAX_LEN_SHORT, MAX_LEN_LONG = 10 + 64 + 32 + 2, 10 + 64 + 64 + 2

# The names and messages of errors.
PARSE_ERRORS = {
    "BlockHashIsTooLong": "block hash is too long",
    "BlockSizeIsEmpty": "block size field is empty",
    "BlockSizeStartsWithZero": "block size starts with '0'",
    "BlockSizeIsInvalid": "block size is not valid",
    "BlockSizeIsTooLarge": "block size is too large",
    "UnexpectedCharacter": "an unexpected character is encountered",
    "UnexpectedEndOfString": "end-of-string is not expected",
}
PARSE_ORIGINS = {"BlockSize": "block size", "BlockHash1": "block hash 1", "BlockHash2": "block hash 2"}
GENERATOR_ERRORS = {
    "FixedSizeMismatch": "current state mismatches to the fixed size previously set",
    "FixedSizeTooLarge": "fixed size is too large to generate a fuzzy hash",
    "InputSizeTooLarge": "input size is too large to generate a fuzzy hash",
    "OutputOverflow": "output is too large for specific fuzzy hash variant",
}
