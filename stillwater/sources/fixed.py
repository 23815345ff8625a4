"""Fixed values of the validation data set."""

# Cycle number and its start (UTC).
CYCLE_START = [
    (1, "2023-07-21 05:33:45"), (2, "2023-08-11 02:18:53"), (3, "2023-08-31 23:03:58"),
    (4, "2023-09-21 19:49:03"), (5, "2023-10-12 16:34:05"), (6, "2023-11-02 13:19:11"),
    (7, "2023-11-23 10:04:16"), (8, "2023-12-14 06:49:20"), (9, "2024-01-04 03:34:26"),
    (10, "2024-01-25 00:19:32"), (11, "2024-02-14 21:04:37"), (12, "2024-03-06 17:49:41"),
    (13, "2024-03-27 14:34:44"), (14, "2024-04-17 11:19:50"), (15, "2024-05-08 08:04:54"),
    (16, "2024-05-29 04:49:59"), (17, "2024-06-19 01:35:04"), (18, "2024-07-09 22:20:07"),
    (19, "2024-07-30 19:05:12"), (20, "2024-08-20 15:50:16"), (21, "2024-09-10 12:35:22"),
    (22, "2024-10-01 09:20:30"), (23, "2024-10-22 06:05:34"), (24, "2024-11-12 02:50:38"),
    (25, "2024-12-02 23:35:43"), (26, "2024-12-23 20:20:47"), (27, "2025-01-13 17:05:51"),
    (28, "2025-02-03 13:50:55"), (29, "2025-02-24 10:36:01"), (30, "2025-03-17 07:21:05"),
    (31, "2025-04-07 04:06:09"), (32, "2025-04-28 00:51:15"), (33, "2025-05-18 21:36:19"),
    (34, "2025-06-08 18:21:24"), (35, "2025-06-29 15:06:30"), (36, "2025-07-20 11:51:36"),
]

# Readings below / above which a gauge is rejected, whole record.
REJECT_BELOW = [
    (4530121723, 286.298), (4530176703, 700.0), (4530179073, 640.0), (4530181863, 680.0),
    (4530267193, 550.0), (4530313823, 130.0), (4530662203, 130.0), (4530670823, 250.0),
    (4530746562, 79.0), (4540003873, 520.0), (4540066493, 580.0), (4550022642, 45.0),
    (4530241183, 515.0), (4530377462, 170.0), (4540009913, 570.0), (4530388743, 95.0),
    (4530389213, 30.0), (4530322143, 80.0), (2510066302, 150.0), (2510207473, 15.0),
    (2510219872, -200000.0), (2510280033, 100.0), (2510280312, -2000.0), (2510163762, 600.0),
    (2510164362, 500.0), (2510165803, 800.0), (2510270043, 0.0), (4320068453, 300.0),
    (7121134183, 233.5), (7121329183, 215.0), (7130096352, 27.0), (7250860123, 376.0),
    (7250891072, 155.0), (7420176273, 362.0), (7720027743, 2400.0), (7740035873, 226.0),
    (8320311912, 300.0),
]
REJECT_ABOVE = [
    (4520010163, 320.0), (4520053003, 317.0), (4530143033, 510.0), (4530176703, 750.0),
    (4530181833, 570.0), (4530181863, 720.0), (4530247173, 350.0), (4530268033, 470.0),
    (4540003332, 200.0), (4540010073, 560.0), (4540028623, 150.0), (4540066493, 620.0),
    (4540095363, 150.0), (4550007133, 120.0), (4550050162, 84.0), (4550070222, 75.0),
    (2510193482, 2000000.0), (7250051493, 2.0), (7421019143, 60.0), (7421075772, 2.0),
    (7421099602, 29.0), (7720027272, 2550.5), (7730019732, 3048.0), (7740037982, 4.0),
]
# Rejections limited in time (from, open?, to, open?, below, above).
REJECT_DURING = [
    (2510165942, "2023-12-31", False, "2025-01-01", False, None, None),
    (7421019143, None, None, "2025-02-10", False, None, 39.0),
    (4340457112, None, None, "2024-04-01", True, None, None),
    (2510260562, "2023-07-01", True, "2023-09-01", True, 241.0, None),
    (2510260562, "2024-03-27", True, "2024-04-04", True, None, 239.5),
]

# Lakes whose gauge record is unusable.
EXCLUDED_LAKES = [
    6420530103, 7421035423, 7520006182, 7520021732, 7120849393, 2320145123, 2320148843, 2140016762,
    2320145652, 7120837533, 7230294612, 7250511622, 8222590692, 7121168993, 7320035782, 7320137783,
    7320345753, 7320361003, 7320057002, 7250202733, 7420084453, 7420932263, 7421075502, 7520007003,
    7520021453, 7720003573, 7720028943, 7730001053, 7830181563, 7310114012, 7830198863, 4530124232,
    4530746652, 4530045882, 4530182732, 4530360803, 4530368712,
]
# Lakes that use the monthly gauge table.
MONTHLY_LAKES = [4530317302, 4530373612, 4530377962, 4530746533, 4530291552, 4530322432, 4530366332]
# Lakes invalid in either product version.
INVALID_LAKES = [
    4330037643, 4530056563, 4530331562, 4530335233, 4530367342, 4530379283, 4540004873, 4550008462,
    4550009812, 4550021542, 4550022152, 4550106402, 6220306162, 6320019482, 6320023772, 6320024182,
    6320029102, 6420513573, 7121032712, 7251059143, 7421074132, 8221430182, 8221477072, 8221479422,
    8221482072,
]


def cleaning_rules(spark):
    """Rule table of the fixed rejections."""
    from .gauges import RULE_SCHEMA

    rows = [(i, None, None, None, None, v, None) for i, v in REJECT_BELOW]
    rows += [(i, None, None, None, None, None, v) for i, v in REJECT_ABOVE]
    rows += REJECT_DURING
    text = RULE_SCHEMA.replace("timestamp_ntz", "string")
    df = spark.createDataFrame(rows, text)
    return df.selectExpr(
        "lake_id", "cast(t_from as timestamp_ntz) t_from", "t_from_open",
        "cast(t_to as timestamp_ntz) t_to", "t_to_open", "v_lt", "v_gt",
    )


def cycle_lookup(spark):
    return spark.createDataFrame(CYCLE_START, "cycle_id int, start_time string").selectExpr(
        "cycle_id", "cast(start_time as timestamp_ntz) start_time"
    )
