"""Names, word lists, thresholds and limits that results depend on."""

# File extensions taken as camera raw files (lower case).
RAW_EXTENSIONS = [
    "raw", "arw", "cr2", "cr3", "nef", "nrw", "orf", "rw2", "pef", "raf", "srw", "dng",
    "3fr", "fff", "iiq", "rwl", "mrw", "x3f", "erf", "kdc", "dcr", "mef", "mos", "ptx",
]

# Statuses, blur types and analysis regions.
SHARP = "Sharp"
SLIGHTLY_BLURRY = "Slightly Blurry"
BLURRY = "Blurry"
NOT_ANALYZED = "Not Analyzed"
STATUSES = [SHARP, SLIGHTLY_BLURRY, BLURRY, NOT_ANALYZED]

BLUR_NONE = "None"
OUT_OF_FOCUS = "Out of Focus"
MOTION_BLUR = "Motion Blur"
MIXED = "Mixed"
UNKNOWN_BLUR = "Unknown"

DETECTOR_EYES = "Eyes (YOLO)"
DETECTOR_HEAD = "Head (YOLO)"
DETECTOR_BODY = "Body (YOLO)"
ANIMAL_EYES = "Animal Eyes"
ANIMAL_HEAD = "Animal Head"
ANIMAL_BODY = "Animal Body"
HUMAN_EYES = "Human Eyes"
HUMAN_FACE = "Human Face"
AF_POINT = "AF Point"
AF_AND_SUBJECT = "AF Point + Subject"
SUBJECT = "Subject (Vision)"
FULL_IMAGE = "Full Image"

# Fixed values: (normalisation divisor, sharp bound, acceptable bound) by region.
EYES_BOUNDS = (200.0, 0.55, 0.25)
HEAD_BOUNDS = (400.0, 0.60, 0.30)
BODY_BOUNDS = (700.0, 0.62, 0.32)
FULL_BOUNDS = (1000.0, 0.65, 0.35)
REGION_BOUNDS = {
    DETECTOR_EYES: EYES_BOUNDS,
    ANIMAL_EYES: EYES_BOUNDS,
    HUMAN_EYES: EYES_BOUNDS,
    DETECTOR_HEAD: HEAD_BOUNDS,
    ANIMAL_HEAD: HEAD_BOUNDS,
    HUMAN_FACE: HEAD_BOUNDS,
    DETECTOR_BODY: BODY_BOUNDS,
    ANIMAL_BODY: BODY_BOUNDS,
    AF_POINT: BODY_BOUNDS,
    AF_AND_SUBJECT: BODY_BOUNDS,
    SUBJECT: FULL_BOUNDS,
    FULL_IMAGE: FULL_BOUNDS,
}

# Limits used by the gates.
MIN_SUBJECT_AREA = 0.002
FULL_SUBJECT_AREA = 0.01
NO_RECT_CONFIDENCE = 0.7
MOTION_RATIO = 0.4
MIN_EYE_AREA = 0.0004
MIN_OVERLAP_AREA = 0.001
DETECTION_GATE = 0.35
KEYPOINT_GATE = 0.3
JOINT_GATE = 0.2
MAX_DETECTIONS = 10
DETECTOR_SIDE = 640
MAX_AF_POINTS = 1024
HEADER_BYTES = 2 * 1024 * 1024
ANALYSIS_SIDE = 1536

# Focus-point tags in order of preference; the first is the precise one.
AF_TAGS = [0x4013, 0x0026, 0x0025]

# Detector labels counted as animals.
ANIMALS = [
    "bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe",
    "deer", "fox", "wolf", "lion", "tiger", "leopard", "cheetah", "monkey", "gorilla", "rabbit",
    "squirrel", "hedgehog", "badger", "otter", "seal", "penguin", "eagle", "hawk", "owl", "parrot",
    "duck", "goose", "swan", "heron", "kingfisher", "woodpecker", "robin", "sparrow", "finch",
    "pigeon", "dove", "crow", "raven", "magpie", "puffin", "gannet", "cormorant", "osprey", "kite",
    "buzzard", "falcon", "kestrel", "merlin", "hobby",
]

# Detector labels counted as birds.
BIRDS = [
    "bird", "eagle", "hawk", "owl", "parrot", "duck", "goose", "swan", "heron", "kingfisher",
    "woodpecker", "robin", "sparrow", "finch", "pigeon", "dove", "crow", "raven", "magpie",
    "puffin", "gannet", "cormorant", "osprey", "kite", "buzzard", "falcon", "kestrel", "merlin",
    "hobby",
]

# Fragments of common names that mark a keyword as a bird.
BIRD_TERMS = [
    "robin", "tit", "finch", "warbler", "thrush", "blackbird", "sparrow", "starling", "pigeon",
    "dove", "hawk", "falcon", "eagle", "owl", "heron", "duck", "goose", "swan", "kite", "buzzard",
    "kestrel", "martin", "swift", "swallow", "wren", "nuthatch", "treecreeper", "woodpecker",
    "kingfisher", "dipper", "bunting", "linnet", "redpoll", "siskin", "goldfinch", "chaffinch",
    "greenfinch", "bullfinch", "crossbill", "jay", "crow", "rook", "jackdaw", "magpie", "raven",
    "chough", "gannet", "cormorant", "shag", "puffin", "guillemot", "razorbill", "tern", "gull",
    "plover", "sandpiper", "curlew", "snipe", "lapwing", "oystercatcher", "redshank", "greenshank",
    "godwit", "knot", "dunlin", "stint", "pheasant", "grouse", "partridge", "quail", "moorhen",
    "coot", "rail", "crake", "bittern", "egret", "spoonbill", "ibis", "osprey", "harrier",
    "merlin", "hobby", "peregrine", "goshawk", "sparrowhawk", "red kite", "white-tailed",
    "golden eagle",
]

# The 80 object classes of the COCO data set, by index.
CLASS_LABELS = [
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat",
    "traffic light", "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat", "dog",
    "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella",
    "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard", "sports ball", "kite",
    "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket", "bottle",
    "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich", "orange",
    "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch", "potted plant",
    "bed", "dining table", "toilet", "tv", "laptop", "mouse", "remote", "keyboard", "cell phone",
    "microwave", "oven", "toaster", "sink", "refrigerator", "book", "clock", "vase", "scissors",
    "teddy bear", "hair drier", "toothbrush",
]

# User-visible messages.
NO_LABEL_ERROR = "No species detected — run focus analysis first."
DECODE_ERROR = "Unable to decode this file. This camera model may not be supported by iOS."
OPEN_ERROR = "Could not open file. Check the file is still accessible."
