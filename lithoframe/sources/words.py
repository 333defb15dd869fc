"""Fixed values of the SEG-Y format: header words, sample formats, text encodings."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np

class Word(NamedTuple):
    """A word of a header: where it is and how it is read."""

    name: str
    byte: int
    kind: str
    unit: str

    @property
    def width(self) -> int:
        return int(self.kind[1])

    @property
    def unsigned(self) -> bool:
        return self.kind[0] == "u"


def _words(table: str) -> list[Word]:
    cells = (line.split() for line in table.strip().splitlines())
    return [Word(c[0], int(c[1]), c[2], c[3] if len(c) > 3 else "") for c in cells]


# Name, first byte from 1 of the file, kind (u without a sign, i with one, and the bytes) and unit of the binary header's words.
BINARY_WORDS = _words("""
job_id 3201 i4
line_number 3205 i4
reel_number 3209 i4
traces_per_ensemble 3213 u2 traces
auxiliary_traces 3215 u2 traces
sample_interval_us 3217 u2 us
original_interval_us 3219 u2 us
sample_count 3221 u2 samples
original_count 3223 u2 samples
format_code 3225 u2
ensemble_fold 3227 u2
trace_sorting 3229 i2
vertical_sum 3231 u2
sweep_start_hz 3233 u2 Hz
sweep_end_hz 3235 u2 Hz
sweep_length_ms 3237 u2 ms
sweep_type 3239 i2
sweep_channel 3241 u2
taper_start_ms 3243 u2 ms
taper_end_ms 3245 u2 ms
taper_type 3247 i2
correlated 3249 i2
gain_recovered 3251 i2
amplitude_recovery 3253 i2
measurement_system 3255 i2
impulse_polarity 3257 i2
vibratory_polarity 3259 i2
revision 3501 u2
fixed_length 3503 u2
extended_headers 3505 i2 headers
max_additional_headers 3507 u4 headers
""")

# The same of a trace header's words, bytes from 1 of the header. The unit "xy" is that of the coordinates.
TRACE_WORDS = _words("""
trace_in_line 1 i4
trace_in_file 5 i4
source_id 9 i4
trace_in_field 13 i4
shotpoint 17 i4
cdp 21 i4
trace_in_ensemble 25 i4
trace_id_code 29 i2
vertical_stack 31 u2
horizontal_stack 33 u2
data_use 35 i2
header_offset 37 i4 xy
receiver_elevation 41 i4 xy
surface_elevation 45 i4 xy
source_depth 49 i4 xy
receiver_datum 53 i4 xy
source_datum 57 i4 xy
source_water_depth 61 i4 xy
receiver_water_depth 65 i4 xy
elevation_scalar 69 i2
coordinate_scalar 71 i2
source_x 73 i4 xy
source_y 77 i4 xy
receiver_x 81 i4 xy
receiver_y 85 i4 xy
coordinate_units 89 i2
weathering_velocity 91 u2
subweathering_velocity 93 u2
source_uphole_ms 95 u2 ms
receiver_uphole_ms 97 u2 ms
source_static_ms 99 i2 ms
receiver_static_ms 101 i2 ms
total_static_ms 103 i2 ms
lag_a_ms 105 i2 ms
lag_b_ms 107 i2 ms
delay_ms 109 i2 ms
mute_start_ms 111 i2 ms
mute_end_ms 113 i2 ms
sample_count 115 u2 samples
sample_interval_us 117 u2 us
gain_type 119 i2
gain_constant 121 i2
initial_gain 123 i2
correlated 125 i2
sweep_start_hz 127 u2 Hz
sweep_end_hz 129 u2 Hz
sweep_length_ms 131 u2 ms
sweep_type 133 i2
taper_start_ms 135 u2 ms
taper_end_ms 137 u2 ms
taper_type 139 i2
alias_hz 141 u2 Hz
alias_slope 143 u2 dB/oct
notch_hz 145 u2 Hz
notch_slope 147 u2 dB/oct
low_cut_hz 149 u2 Hz
high_cut_hz 151 u2 Hz
low_cut_slope 153 u2 dB/oct
high_cut_slope 155 u2 dB/oct
year 157 u2
day_of_year 159 u2
hour 161 u2
minute 163 u2
second 165 u2
time_basis 167 i2
weighting_factor 169 i2
roll_position 171 i2
first_trace_group 173 i2
last_trace_group 175 i2
gap_size 177 i2
over_travel 179 i2
cdp_x 181 i4 xy
cdp_y 185 i4 xy
inline 189 i4
crossline 193 i4
shotpoint_number 197 i4
shotpoint_scalar 201 i2
value_unit 203 i2
transduction_mantissa 205 i4
transduction_exponent 209 i2
transduction_unit 211 i2
device_id 213 i2
time_scalar 215 i2
source_type 217 i2
source_energy_mantissa 219 i4
source_energy_exponent 223 i2
source_measure_mantissa 225 i4
source_measure_exponent 229 i2
source_measure_unit 231 i2
""")
#: Scalar word of the words that have one.
SCALED_BY = {
    **dict.fromkeys("receiver_elevation surface_elevation source_depth receiver_datum source_datum source_water_depth receiver_water_depth".split(), "elevation_scalar"),
    **dict.fromkeys("source_x source_y receiver_x receiver_y cdp_x cdp_y".split(), "coordinate_scalar"),
    "shotpoint_number": "shotpoint_scalar",
}

# Bytes per sample by format code; code 4 has a size but no meaning here.
SAMPLE_BYTES = {1: 4, 2: 4, 3: 2, 4: 4, 5: 4, 6: 8, 7: 3, 8: 1, 9: 8, 10: 4, 11: 2, 12: 8, 15: 3, 16: 1}
_PLAIN = {2: "i4", 3: "i2", 5: "f4", 6: "f8", 8: "i1", 9: "i8", 10: "u4", 11: "u2", 12: "u8", 16: "u1"}


def ibm_to_float(words: np.ndarray) -> np.ndarray:
    """IBM single precision: sign, exponent of 16 with excess 64, 24 bits of fraction."""
    w = words.astype(np.uint32)
    fraction = (w & 0x00FFFFFF).astype(np.float64) / float(1 << 24)
    return np.where(w >> 31, -1.0, 1.0) * fraction * np.power(16.0, ((w >> 24) & 0x7F).astype(np.float64) - 64)


def float_to_ibm(values: np.ndarray) -> np.ndarray:
    """The nearest IBM word of each value; non-finite values become 0."""
    v = np.where(np.isfinite(values), values, 0.0).astype(np.float64)
    m, e2 = np.frexp(np.abs(v))
    e16 = -(-e2 // 4)
    f = np.rint(m * np.power(2.0, (e2 - 4 * e16).astype(float)) * (1 << 24)).astype(np.int64)
    e16 = np.where(f == 1 << 24, e16 + 1, e16)
    f = np.where(f == 1 << 24, 1 << 20, f)
    return np.where(v == 0, 0, (np.signbit(v).astype(np.int64) << 31) | ((e16 + 64) << 24) | f).astype(np.uint32)


def decode_samples(data: bytes, code: int, little: bool) -> np.ndarray:
    """Samples as doubles; NaN for a code that can't be decoded."""
    order = "<" if little else ">"
    if code == 1:
        return ibm_to_float(np.frombuffer(data, order + "u4"))
    if code in _PLAIN:
        return np.frombuffer(data, order + _PLAIN[code]).astype(np.float64)
    if code in (7, 15):
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int64)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16 if little else b[:, 2] | b[:, 1] << 8 | b[:, 0] << 16
        return (np.where(v >= 1 << 23, v - (1 << 24), v) if code == 7 else v).astype(np.float64)
    return np.full(len(data) // SAMPLE_BYTES.get(code, 4), np.nan)


def encode_samples(values: np.ndarray, code: int, little: bool) -> bytes:
    """The bytes of samples in a format; whole-number formats round and clamp."""
    order = "<" if little else ">"
    if code == 1:
        return float_to_ibm(values).astype(order + "u4").tobytes()
    if code in (5, 6):
        return values.astype(order + _PLAIN[code]).tobytes()
    if code in (7, 15):
        lo, hi = (-(1 << 23), (1 << 23) - 1) if code == 7 else (0, (1 << 24) - 1)
        v = np.clip(np.rint(np.nan_to_num(values)), lo, hi).astype(np.int64) & 0xFFFFFF
        planes = [v & 255, v >> 8 & 255, v >> 16]
        return np.stack(planes if little else planes[::-1], 1).astype(np.uint8).tobytes()
    if code in _PLAIN:
        info = np.iinfo(_PLAIN[code])
        return np.array([min(max(int(x), info.min), info.max) for x in np.rint(np.nan_to_num(values))], dtype=order + _PLAIN[code]).tobytes()
    raise ValueError(f"no encoding for sample format {code}")


def read_word(raw: bytes, at: int, width: int, little: bool, unsigned: bool = False) -> int:
    return int.from_bytes(raw[at : at + width], "little" if little else "big", signed=not unsigned)


TEXT_ENCODINGS = {"ascii": "latin-1", "ebcdic-cp037": "cp037"}
#: What a sign of a decoded text header counts, and a line that starts as a card ("C 1", "C12").
BLANK_POINTS, PLAIN_POINTS, PRINTED_POINTS, LOST_POINTS, CARD_POINTS = 3, 4, 2, -8, 40
_CARD = re.compile("C ?[0-9]")


def _sign(c: str) -> str:
    return " " if c in "\0\r\n\t" else c if c.isprintable() else "\ufffd"


_DECODED = {name: [_sign(bytes([k]).decode(codec)) for k in range(256)] for name, codec in TEXT_ENCODINGS.items()}
_POINTS = {name: np.array([BLANK_POINTS if c == " " else LOST_POINTS if c == "\ufffd" else PLAIN_POINTS if c.isascii() and c.isalnum() else PRINTED_POINTS for c in signs]) for name, signs in _DECODED.items()}


def decode_text(raw: bytes, encoding: str | None = None) -> list[str]:
    """The 40 lines of 80 characters of a text header, in the encoding given or the likelier one.

    NUL, tab and line ends are blanks, other signs that can't be printed U+FFFD. Raises ValueError for
    other than 3200 bytes or an unknown encoding.
    """
    if len(raw) != 3200:
        raise ValueError(f"a text header has 3200 bytes, not {len(raw)}")
    encoding = encoding or text_encoding(raw)
    if encoding not in _DECODED:
        raise ValueError(f"a text header's encoding is one of {', '.join(_DECODED)}, not {encoding!r}")
    signs = _DECODED[encoding]
    text = "".join([signs[k] for k in raw])
    return [text[i : i + 80] for i in range(0, 3200, 80)]


def text_score(raw: bytes, encoding: str) -> int:
    """How much a decoding looks like a text header."""
    points = int(_POINTS[encoding][np.frombuffer(raw, np.uint8)].sum())
    return points + CARD_POINTS * sum(bool(_CARD.match(line)) for line in decode_text(raw, encoding))


def text_encoding(raw: bytes) -> str:
    """'ascii' or 'ebcdic-cp037'; ASCII at a tie."""
    return max(TEXT_ENCODINGS, key=lambda e: text_score(raw, e))
