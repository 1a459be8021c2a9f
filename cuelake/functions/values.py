"""Label lists, phrases, codes and limits that decide results."""

# --- fixed values: sound class -> caption text (many classes share a caption) ---
SOUND_CAPTIONS = {
    "Applause": "APPLAUSE",
    "Clapping": "APPLAUSE",
    "Cheering": "CHEERING",
    "Crowd": "CROWD NOISE",
    "Chatter": "CROWD CHATTER",
    "Hubbub, speech noise, speech babble": "CROWD CHATTER",
    "Laughter": "LAUGHTER",
    "Giggle": "LAUGHTER",
    "Chuckle, chortle": "LAUGHTER",
    "Baby laughter": "LAUGHTER",
    "Music": "MUSIC",
    "Musical instrument": "MUSIC",
    "Singing": "SINGING",
    "Choir": "SINGING",
    "Theme music": "MUSIC",
    "Background music": "MUSIC",
    "Jingle (music)": "MUSIC",
    "Crying, sobbing": "CRYING",
    "Baby cry, infant cry": "BABY CRYING",
    "Whistling": "WHISTLING",
    "Shout": "SHOUTING",
    "Yell": "SHOUTING",
    "Screaming": "SCREAMING",
    "Cough": "COUGHING",
    "Sneeze": "SNEEZE",
    "Gasp": "GASP",
    "Telephone bell ringing": "PHONE RINGING",
    "Ringtone": "PHONE RINGING",
    "Telephone": "PHONE RINGING",
    "Doorbell": "DOORBELL",
    "Ding-dong": "DOORBELL",
    "Alarm": "ALARM",
    "Alarm clock": "ALARM",
    "Buzzer": "BUZZER",
    "Smoke detector, smoke alarm": "ALARM",
    "Fire alarm": "FIRE ALARM",
    "Siren": "SIREN",
    "Civil defense siren": "SIREN",
    "Emergency vehicle": "SIREN",
    "Bell": "BELL",
    "Church bell": "BELL TOLLING",
    "Explosion": "EXPLOSION",
    "Boom": "BOOM",
    "Eruption": "EXPLOSION",
    "Gunshot, gunfire": "GUNFIRE",
    "Machine gun": "GUNFIRE",
    "Artillery fire": "GUNFIRE",
    "Fusillade": "GUNFIRE",
    "Fireworks": "FIREWORKS",
    "Firecracker": "FIREWORKS",
    "Knock": "KNOCKING",
    "Slam": "DOOR SLAM",
    "Breaking": "GLASS BREAKING",
    "Shatter": "GLASS BREAKING",
    "Glass": "GLASS BREAKING",
    "Bang": "BANG",
    "Thump, thud": "THUD",
    "Thunder": "THUNDER",
    "Thunderstorm": "THUNDER",
    "Rain": "RAIN",
    "Wind": "WIND",
    "Wind noise (microphone)": "WIND",
    "Dog": "DOG BARKING",
    "Bark": "DOG BARKING",
    "Vehicle horn, car horn, honking": "HORN HONKING",
    "Train horn": "TRAIN HORN",
    "Helicopter": "HELICOPTER",
    "Aircraft": "AIRCRAFT",
}

# --- fixed values: classes that count as speech ---
SPEECH_LABELS = (
    "Speech",
    "Male speech, man speaking",
    "Female speech, woman speaking",
    "Child speech, kid speaking",
    "Conversation",
    "Narration, monologue",
    "Speech synthesizer",
)

# --- fixed values: captions that may run under dialogue ---
COEXIST_CAPTIONS = ("MUSIC", "APPLAUSE", "CHEERING", "CROWD NOISE")

# --- fixed values: phrases recognisers invent over silence ---
SILENCE_PHRASES = (
    "thank you",
    "thank you very much",
    "thank you so much",
    "thanks for watching",
    "thank you for watching",
    "thank you for listening",
    "please subscribe",
    "like and subscribe",
    "see you next time",
    "bye",
    "bye bye",
)

# --- fixed values: line-21 byte pairs, parity bit included, and their notes ---
PAIR_NOTES = (
    (0x94, 0x25, "RU2 — Roll-Up 2 rows"),
    (0x94, 0xA6, "RU3 — Roll-Up 3 rows"),
    (0x94, 0x27, "RU4 — Roll-Up 4 rows"),
    (0x94, 0xAD, "CR  — Carriage Return"),
    (0x94, 0x2C, "EDM — Erase Displayed Memory"),
    (0x94, 0xAF, "EOC — End of Caption"),
    (0x80, 0x80, "NULL"),
)
CONTROL = 0x94
NULL = 0x80
CARRIAGE_RETURN = 0xAD
ERASE = 0x2C
PREAMBLE_ROW15 = 0xE0
ROLL_UP = {2: 0x25, 3: 0xA6, 4: 0x27}

# --- fixed values: 708 commands ---
SET_WINDOW_0 = 0x80
RESET = 0x8F
DEFINE_WINDOW_0 = (0x98, 0x04, 74, 105, 0x71, 31, 0x09)
DTVCC_START = 6
DTVCC_DATA = 7

# --- fixed values: layout and timing limits ---
LINE_WIDTH = 32
MAX_LINES = 2
TAIL_CHARS = 80
CUE_POSITION = "line:90%,end align:center"
REINIT_ROWS = 3
QUEUE_LIMIT = 2000
LATENCY_WINDOW = 50
LATENCY_LIMIT_MS = 2000
SIGNAL_TIMEOUT_MS = 6000
FLUSH_GAP_MS = 500
IDLE_CLEAR_MS = 6000
REVIEW_DELAY_MS = 4000
TARGET_DELAY_MS = 20000
SENTENCE_END = r"""[.!?…]["'')\]]?$"""
PUNCTUATION = ",.!?;:"
STREAM_SCHEMES = ("rtmp://", "rtmps://", "rtsp://", "srt://")
NOT_AVAILABLE = ("", "[N/A]", "N/A", "[Not Supported]")
