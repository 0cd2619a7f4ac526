"""Comorbidity flags of admissions from secondary diagnosis codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# For each flag its full codes, 4-character and 3-character beginnings.
CODES = {
    "chf": ("39891 40201 40211 40291 40401 40403 40411 40413 40491 40493", "4254 4255 4257 4258 4259", "428"),
    "arrhy": ("42613 42610 42612 99601 99604", "4260 4267 4269 4270 4271 4272 4273 4274 4276 4278 4279 7850 V450 V533", ""),
    "valve": ("", "0932 7463 7464 7465 7466 V422 V433", "394 395 396 397 424"),
    "pulmcirc": ("", "4150 4151 4170 4178 4179", "416"),
    "perivasc": ("", "0930 4373 4431 4432 4438 4439 4471 5571 5579 V434", "440 441"),
    "htn": ("", "", "401"),
    "htncx": ("", "", "402 403 404 405"),
    "para": ("", "3341 3440 3441 3442 3443 3444 3445 3446 3449", "342 343"),
    "neuro": ("33392", "3319 3320 3321 3334 3335 3362 3481 3483 7803 7843", "334 335 340 341 345"),
    "chrnlung": ("", "4168 4169 5064 5081 5088", "490 491 492 493 494 495 496 500 501 502 503 504 505"),
    "dm": ("", "2500 2501 2502 2503", ""),
    "dmcx": ("", "2504 2505 2506 2507 2508 2509", ""),
    "hypothy": ("", "2409 2461 2468", "243 244"),
    "renlfail": ("40301 40311 40391 40402 40403 40412 40413 40492 40493", "5880 V420 V451", "585 586 V56"),
    "liver": ("07022 07023 07032 07033 07044 07054", "0706 0709 4560 4561 4562 5722 5723 5724 5728 5733 5734 5738 5739 V427", "570 571"),
    "ulcer": ("", "5317 5319 5327 5329 5337 5339 5347 5349", ""),
    "aids": ("", "", "042 043 044"),
    "lymph": ("", "2030 2386", "200 201 202"),
    "mets": ("", "", "196 197 198 199"),
    "tumor": ("", "", "140 141 142 143 144 145 146 147 148 149 150 151 152 153 154 155 156 157 158 159 160 161 162 163 164 165 166 167 168 169 170 171 172 174 175 176 177 178 179 180 181 182 183 184 185 186 187 188 189 190 191 192 193 194 195"),
    "arth": ("72889 72930", "7010 7100 7101 7102 7103 7104 7108 7109 7112 7193 7285", "446 714 720 725"),
    "coag": ("", "2871 2873 2874 2875", "286"),
    "obese": ("", "2780", ""),
    "wghtloss": ("", "7832 7994", "260 261 262 263"),
    "lytes": ("", "2536", "276"),
    "bldloss": ("", "2800", ""),
    "anemdef": ("", "2801 2808 2809", "281"),
    "alcohol": ("", "2652 2911 2912 2913 2915 2918 2919 3030 3039 3050 3575 4255 5353 5710 5711 5712 5713 V113", "980"),
    "drug": ("V6542", "3052 3053 3054 3055 3056 3057 3058 3059", "292 304"),
    "psych": ("29604 29614 29644 29654", "2938", "295 297 298"),
    "depress": ("", "2962 2963 2965 3004", "309 311"),
}
# The view's columns in order, with the flags that make each: itself, either, or the first but not the second.
VIEW = {
    "congestive_heart_failure": ("chf",), "cardiac_arrhythmias": ("arrhy",), "valvular_disease": ("valve",), "pulmonary_circulation": ("pulmcirc",),
    "peripheral_vascular": ("perivasc",), "hypertension": ("htn", "or", "htncx"), "paralysis": ("para",), "other_neurological": ("neuro",),
    "chronic_pulmonary": ("chrnlung",), "diabetes_uncomplicated": ("dm", "not", "dmcx"), "diabetes_complicated": ("dmcx",), "hypothyroidism": ("hypothy",),
    "renal_failure": ("renlfail",), "liver_disease": ("liver",), "peptic_ulcer": ("ulcer",), "aids": ("aids",), "lymphoma": ("lymph",), "metastatic_cancer": ("mets",),
    "solid_tumor": ("tumor", "not", "mets"), "rheumatoid_arthritis": ("arth",), "coagulopathy": ("coag",), "obesity": ("obese",), "weight_loss": ("wghtloss",),
    "fluid_electrolyte": ("lytes",), "blood_loss_anemia": ("bldloss",), "deficiency_anemias": ("anemdef",), "alcohol_abuse": ("alcohol",), "drug_abuse": ("drug",),
    "psychoses": ("psych",), "depression": ("depress",),
}


LENGTHS = (None, 4, 3)  # of the beginnings: the whole code, 4 and 3 characters


def code_masks(spark: SparkSession) -> DataFrame:
    """kind (place in LENGTHS), part, mask: the flags, as bits in the order of CODES, that a code or its beginning has. A few hundred rows, fixed by CODES."""
    masks: dict[tuple[int, str], int] = {}
    for bit, parts in enumerate(CODES.values()):
        for kind, codes in enumerate(parts):
            for code in codes.split():
                masks[kind, code] = masks.get((kind, code), 0) | 1 << bit
    return spark.createDataFrame([(kind, part, mask) for (kind, part), mask in masks.items()], "kind int, part string, mask long")


def secondary_flags(diagnoses: DataFrame) -> DataFrame:
    """hadm_id with the 31 flags over its codes whose seq_num is not 1 (rows without one are left out); a null code has none.

    A code carries its flags as one number, which is combined before the one shuffle on hadm_id and taken apart after it.
    """
    rows, masks = diagnoses.where("seq_num <> 1").select("hadm_id", "icd9_code"), code_masks(diagnoses.sparkSession)
    for kind, n in enumerate(LENGTHS):
        own = masks.where(F.col("kind") == kind).select(F.col("part").alias(f"part{kind}"), F.col("mask").alias(f"mask{kind}"))
        code = F.col("icd9_code") if n is None else F.substring("icd9_code", 1, n)
        rows = rows.join(F.broadcast(own), code == F.col(f"part{kind}"), "left")
    mask = F.lit(0).cast("long")
    for kind in range(len(LENGTHS)):
        mask = mask.bitwiseOR(F.coalesce(f"mask{kind}", F.lit(0)))
    found = rows.groupBy("hadm_id").agg(F.bit_or(mask).alias("mask"))
    return found.select("hadm_id", *[F.shiftright("mask", bit).bitwiseAND(1).cast("int").alias(name) for bit, name in enumerate(CODES)])


def comorbidity_view(admissions: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """All admissions with the view's columns.

    Admissions without a secondary code have null in plain columns and 0 in those that merge two flags.
    """

    def column(spec: tuple[str, ...]) -> Column:
        if len(spec) == 1:
            return F.col(spec[0])
        a, how, b = spec
        test = (F.col(a) == 1) | (F.col(b) == 1) if how == "or" else (F.col(a) == 1) & (F.col(b) != 1)
        return F.when(test, 1).otherwise(0)

    joined = admissions.select("hadm_id").join(secondary_flags(diagnoses), "hadm_id", "left")
    return joined.select("hadm_id", *[column(s).alias(n) for n, s in VIEW.items()])
