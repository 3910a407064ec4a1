"""Label vocabularies.

The tables below are fixed values: they must hold exactly these words for the
results to be right. Keys are written as the matching text rule produces them.
The large free-text vocabulary is not shipped; it is given as a table with the
columns ``variant`` and ``canonical`` (see ``operators.labels.label_lookup``).
"""

# Audit vocabulary, canonical label -> normalised comments.
AUDIT = {
    "Normal": (
        "normal",
        "beta wave",
        "beta waves",
        "beta activity",
        "alpha coma",
    ),
    "Sharp Wave": (
        "sharp wave",
        "sharp waves",
        "generalized sharp waves",
        "generalized sharp waves discharge",
        "sharp and wave",
        "sharp wave discharges",
        "sharp wave pre del both",
        "triphasic wave",
        "triphasic waves",
        "periodic & semiperiodic & triphasic wave",
        "periodic & semiperiodic & triphasic wave & complexes",
        "periodic & semiperiodic & triphasic wave & sharp & slow wave & complexes",
        "semi periodic triphasic",
        "semi periodic triphasic wave",
        "semiperiodic triphasic wave complexes",
        "triphaic waves",
        "triphasic waves sharp waves",
        "semiperiodic triphasic wavecomplexes",
        "semiperiodic triphasic wave",
        "burst suppression",
        "burst suppression pattern",
        "sharp and slow wave",
        "focal sharp and slow wave",
        "sharp and delta waves",
        "sharp & delta wave",
        "sharp & slow wave activity",
        "sharp and delta slow wave",
        "sharp and slow wave activity",
        "sharp and slow wave discharges",
        "slow and sharp wave",
        "sharp & delta slow waves",
        "sharp and deta wave",
        "sharp ans slow wave discharges",
        "sharp and delta slow waves",
        "sharp and delta wave",
        "sharp and slow waves",
    ),
    "Delta Slow Wave": (
        "delta slow wave",
        "delta waves",
        "delta slow waves",
        "slowing wave",
        "generalized paroxymal delta slow waves",
        "generalized paroxysmal delta slow waves",
        "generalized parosysmal delta slow waves",
        "generalized delta slow waves",
        "slow waves",
        "paroxysmal delta slow waves",
        "paroxysmal generalized delta slow waves",
        "delta",
        "delta wave",
        "changegeneralized delta slow waves",
        "dela slow waves",
        "delta slow waves with muscle artifacts",
        "delta slowing",
        "frontal delta slowing",
        "frontal slow wave",
        "frontal slow wave activity",
        "generalized delta slow waves discharge",
        "generalized delta slowing",
        "generalized slowing",
        "generalized slowing in delta range",
        "mild slowing",
        "mild generalized slowing",
        "slow wave",
        "slow wave activity",
        "slow wave discharges",
        "delta wavest",
        "delta low waves",
        "delta slo waves",
        "delta sloww aves",
        "delta sloww waves",
        "delta slowwaves",
        "generaliaed slowing",
        "generalize slowing",
        "generalizied slowing",
        "generalizwd delta slowing",
        "generilized slowing",
        "generlized slowing",
        "generralized slowing",
        "mild generilized slowing",
        "mild generlized slowing",
        "delta prev",
        "generalized slowing mixed with artifacts",
    ),
    "Spike and Wave": (
        "spike and wave",
        "2 hertz slow spike and wave discharge",
        "spike wave",
        "spikes",
        "generalized paroxysmal spike and wave discharge",
        "generalized paroxymal spike and wave discharge",
        "fragmented spike and wave discharge",
        "generalized paroxysmal 3 hertz spike and wave discharge",
        "generalized spike and wave discharge",
        "generalized spike and wave discharges",
        "spike and wave discharge",
        "spike and waves",
        "generalized spike and wave",
        "spike",
        "spiek and wave",
        "3hz spike and wave",
        "3hz spike and wave discharges",
        "brust of spike and wave",
        "spike & wave discharges",
        "spike and wave activity",
        "spike and wave discharges",
        "spike snd wave",
        "slow spike and wave",
        "spike and wave dischages",
        "rolandic spikes",
        "rolandic spike",
    ),
    "Polyspike": (
        "polyspike",
        "generalized plolyspikes discharge",
        "generalized polyspike pattern",
        "polyspike and wave discharges",
        "polyspike wave discharges",
        "polyspikes & wave",
        "polypspikes and wave",
        "generalized polyspikes discharge",
        "generalized polyspike discharge",
        "polyspikes discharge",
        "polyspikes and wave",
        "polyspikes",
        "polyspike and wave",
    ),
    "Spike Wave and Polyspike Wave": (
        "spike wave and polyspike wave",
        "generalized spike & polyspike pattern",
        "generalized spike & polyspike wave",
        "spike & poilyspike wave",
        "spike & polyspike",
        "spike & polyspike and wave",
        "spike & polyspike wave",
        "spike &polyspike and wave discharges",
        "spike polyspike and wave discharges",
    ),
    "Theta Wave": (
        "theta wave",
        "theta waves",
        "theta slow wave",
        "generalized slowing in theta range",
        "mild generilized slowing in theta range",
        "theta slow waves",
        "theta wavs",
    ),
    "Delta and Theta Wave": (
        "delta and theta wave",
        "delta and theta waves",
        "delta theta slowing",
        "frontal dela to theta slowing",
        "generalized slowing in delta to theta range",
        "generalized slowing in delta thta range",
    ),
    "Spike And Delta Slow Waves": (
        "spike and delta slow waves",
        "spike and wave discharges followed by generalized slowing",
        "spike and wave discharges followed by slowing",
        "spike and wave discharges with generalized slowing",
    ),
    "Low Voltage": (
        "low voltage",
        "no waveform",
        "low voltage suppression",
        "no electrical activity",
        "no voltage",
        "low voltagev",
        "loww voltage",
    ),
    "Artifacts": (
        "artifacts",
        "artifact",
        "blink artifacts",
        "frontal area artifacts",
        "artifracts",
        "articats",
        "artifacds",
    ),
    "Unknown": (
        "unknown",
        "no comment",
        "delete previous",
        "nan",
    ),
}

# Clinical vocabulary, canonical label -> normalised comments.
CLINICAL = {
    "Burst Suppression": (
        "burst suppression",
        "suppression",
        "burstsuppression",
        "bursts and suppression",
        "generalized burst suppression",
    ),
    "Low Voltage": (
        "low voltage",
        "no waveform",
        "low volatge",
        "loww voltage",
        "low volage",
        "no electrical activity",
        "no electrical effects",
        "no elecctrical activity",
        "no electrical avtivity",
        "no electrtical activity",
        "no voltage",
        "flat",
        "isoelectric",
        "attenuation",
        "electrocerebral silence",
        "low volatge no waveform",
        "background attenuation",
        "suppressed background",
    ),
    "Spike and Wave": (
        "spike and wave",
        "spike",
        "spikes",
        "spike wave",
        "3hz spike and wave",
        "generalized spike and wave",
        "generalized spike and wave discharge",
        "generalized periodic epileptiform discharges",
        "gped",
        "gpeds",
        "pleds",
        "ped",
        "peds",
        "periodic discharges",
        "spk",
        "sw",
        "gsw",
        "spikewave",
        "2 hertz slow spike and wave discharge",
        "slow spike and wave",
        "rolandic spike",
        "rolandic spikes",
        "focal spikes",
        "multifocal spikes",
        "generalized paroxysmal spike and wave discharge",
        "generalized paroxymal spike and wave discharge",
        "spike and wave discharge",
        "fragmented spike and wave discharge",
    ),
    "Polyspike": (
        "polyspike",
        "polyspikes",
        "polyspike and wave",
        "polyspikes and wave",
        "polypspikes and wave",
        "generalized polyspikes",
        "generalized polyspikes discharge",
        "polyspikes discharge",
        "generalized polyspike discharge",
        "spike polyspike",
        "spike polyspike wave",
        "spike polyspike and wave",
        "generalized spike polyspike pattern",
        "spike and polyspike",
        "generalized spike polyspike wave",
    ),
    "Sharp Wave": (
        "sharp waves",
        "sharp wave",
        "generalized sharp waves",
        "generalized sharp waves discharge",
        "sharp",
        "sharp and slow",
        "sharp and slow wave",
        "focal sharp waves",
        "multifocal sharp waves",
        "vertex sharp waves",
        "biphasic sharp waves",
    ),
    "Spike and Delta": (
        "spike and delta slow waves",
        "spike and delta",
        "spike and wave discharges followed by generalized slowing",
        "spike and wave discharges with generalized slowing",
        "spike and slow wave",
        "spikes and slowing",
    ),
    "Triphasic Wave": (
        "triphasic waves",
        "triphasic",
        "triphaic waves",
        "triphasic morphology",
        "generalized triphasic waves",
        "triphasic wave",
    ),
    "Delta Slow Wave": (
        "delta slow wave",
        "delta waves",
        "delta",
        "slowing",
        "generalized slowing",
        "generalized delta",
        "focal slowing",
        "slow waves",
        "intermittent rhythmic delta activity",
        "firda",
        "oda",
        "irda",
        "generalized delta slow waves",
        "paroxysmal delta slow waves",
        "generalized paroxymal delta slow waves",
        "diffuse slowing",
        "continuous slowing",
        "slow wave",
        "slow wave activity",
        "dela slow waves",
        "sharp and delta slow waves",
    ),
    "Theta Wave": (
        "theta waves",
        "theta wave",
        "theta slow waves",
        "theta",
        "theta slowing",
        "generalized slowing in theta range",
        "focal theta",
    ),
    "Delta and Theta Wave": (
        "delta and theta waves",
        "deltatheta slowing",
        "delta theta",
        "frontal dela to theta slowing",
        "generalized slowing in delta to theta range",
        "generalized slowing in deltathta range",
        "mixed slowing",
        "delta and theta wave",
    ),
    "Artifacts": (
        "artifact",
        "movement",
        "muscle",
        "blink",
        "chewing",
        "electrode",
        "pop",
        "60hz",
        "ekg",
        "artifracts",
        "articats",
        "artifacds",
        "artifacts",
        "frontal area artifacts",
        "eye movement",
        "emg",
        "mains noise",
        "sweat artifact",
    ),
    "Normal": (
        "normal",
        "beta wave",
        "beta waves",
        "beta activity",
        "beta",
        "fast activity",
        "alpha coma",
        "alpha rhythm",
        "posterior dominant rhythm",
        "no comment",
        "nan",
        "unknown",
        "trace",
        "delete previous",
        "v",
        "end of file",
        "data",
        "file",
        "sleep spindles",
        "kcomplex",
        "vertex waves",
    ),
}

# Keyword rules for comments outside the clinical vocabulary.
# Every word of a rule must occur; the first rule that holds decides.
CLINICAL_RULES = (
    (("burst",), "Burst Suppression"),
    (("triphasic",), "Triphasic Wave"),
    (("spike", "delta"), "Spike and Delta"),
    (("delta", "theta"), "Delta and Theta Wave"),
    (("polyspike",), "Polyspike"),
    (("spike",), "Spike and Wave"),
    (("periodic", "discharge"), "Spike and Wave"),
    (("sharp",), "Sharp Wave"),
    (("theta",), "Theta Wave"),
    (("delta",), "Delta Slow Wave"),
    (("slow wave",), "Delta Slow Wave"),
    (("slowing",), "Delta Slow Wave"),
    (("low voltage",), "Low Voltage"),
    (("no voltage",), "Low Voltage"),
    (("electrical activity",), "Low Voltage"),
    (("isoelectric",), "Low Voltage"),
    (("artifact",), "Artifacts"),
    (("beta",), "Normal"),
    (("alpha",), "Normal"),
)

# Coarse class of a canonical label; others keep their name.
COARSE = {
    "Sharp Wave": "Epileptiform",
    "Delta Slow Wave": "Slowing",
    "Spike and Wave": "Epileptiform",
    "Polyspike": "Epileptiform",
    "Spike Wave and Polyspike Wave": "Epileptiform",
    "Theta Wave": "Slowing",
    "Delta and Theta Wave": "Slowing",
    "Spike And Delta Slow Waves": "Epileptiform",
}

# Clinical family of a label; anything else is "Other".
FAMILY = {
    "Burst Suppression": "Critical",
    "Low Voltage": "Critical",
    "Spike and Wave": "Epileptiform",
    "Polyspike": "Epileptiform",
    "Sharp Wave": "Epileptiform",
    "Spike and Delta": "Epileptiform",
    "Triphasic Wave": "Slowing",
    "Delta Slow Wave": "Slowing",
    "Theta Wave": "Slowing",
    "Delta and Theta Wave": "Slowing",
    "Delta and Theta": "Slowing",
    "Artifacts": "Other",
    "Normal": "Other",
}
FAMILIES = ("Epileptiform", "Slowing", "Critical", "Other")

CANONICAL_ORDER = tuple(AUDIT)
CLINICAL_ORDER = tuple(CLINICAL)
# Coarse labels by first appearance in the canonical order, "Unknown" last.
COARSE_ORDER = tuple(dict.fromkeys(COARSE.get(c, c) for c in CANONICAL_ORDER))
# The ten labels that count as a successful mapping.
EVENT_LABELS = tuple(c for c in CANONICAL_ORDER if c not in ("Normal", "Unknown"))
# Every clinical label is also its own only variant.
IDENTITY = {c: (c.lower(),) for c in CLINICAL_ORDER}
