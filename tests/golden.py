"""Golden numbers of the four monthly report files and class tables.

FIXED VALUES: copied as numbers from the reference's published monthly
reports (tag counts, percentages as printed) and class/subject tables.
"""

MONTHS = ["jan", "feb", "mar", "apr"]

# Stage-1 tag counts per month, in report order: success, nothing entered,
# task, not maths, outside 5-11, topic coming soon, left after match,
# match failed.
STAGE1 = {
    "jan": [1623, 4, 40, 158, 41, 0, 52, 166],
    "feb": [1609, 6, 88, 221, 22, 0, 43, 109],
    "mar": [2474, 6, 81, 221, 47, 2, 140, 187],
    "apr": [2158, 9, 84, 166, 32, 2, 105, 167],
}
# Printed stage-1 percentages (of uninterrupted dialogs), same order.
STAGE1_PCT = {
    "jan": [78.0, 0.2, 1.9, 7.6, 2.0, 0.0, 2.5, 8.0],
    "feb": [76.9, 0.3, 4.2, 10.6, 1.1, 0.0, 2.1, 5.2],
    "mar": [78.5, 0.2, 2.6, 7.0, 1.5, 0.1, 4.4, 5.9],
    "apr": [79.5, 0.3, 3.1, 6.1, 1.2, 0.1, 3.9, 6.2],
}
UNINTERRUPTED = {"jan": 2080, "feb": 2092, "mar": 3152, "apr": 2714}
TOTAL = {"jan": 2084, "feb": 2098, "mar": 3158, "apr": 2723}
# Stage-2 rows: solved, saw final, left after step 1, left after plan —
# (count, % of successes, % of all dialogs).
STAGE2 = {
    "jan": [(273, 16.8, 13.1), (115, 7.1, 5.5), (531, 32.7, 25.5), (135, 8.3, 6.5)],
    "feb": [(278, 17.3, 13.3), (61, 3.8, 2.9), (532, 33.1, 25.4), (84, 5.2, 4.0)],
    "mar": [(366, 14.8, 11.6), (94, 3.8, 3.0), (916, 37.0, 29.0), (528, 21.3, 16.7)],
    "apr": [(281, 13.0, 10.3), (60, 2.8, 2.2), (807, 37.4, 29.6), (543, 25.2, 19.9)],
}
# Conversion table: (count, printed %) for total, uninterrupted, success, solved.
CONVERSION = {
    "jan": [(2084, 100.0), (2080, 99.8), (1623, 78.0), (273, 13.1)],
    "feb": [(2098, 100.0), (2092, 99.7), (1609, 76.9), (278, 13.3)],
    "mar": [(3158, 100.0), (3152, 99.8), (2474, 78.5), (366, 11.6)],
    "apr": [(2723, 100.0), (2714, 99.7), (2158, 79.5), (281, 10.4)],
}
# Matching funnel (A-3) counts and the last stage's drop.
MATCHING_FUNNEL = {
    "jan": ([2084, 2080, 2040, 1882, 1841, 1789, 1623], -166),
    "feb": ([2098, 2092, 2004, 1783, 1761, 1718, 1609], -109),
    "mar": ([3158, 3152, 3071, 2850, 2803, 2663, 2474], -189),
    "apr": ([2723, 2714, 2630, 2464, 2432, 2327, 2158], -169),
}
# Post funnel (A-4) counts, reading the unlisted remainder of the successes as
# the "left after step 2+" tag (an inference: the report omits that tag).
POST_FUNNEL = {
    "jan": [1623, 1488, 957, 388, 273, 273],
    "feb": [1609, 1525, 993, 339, 278, 278],
    "mar": [2474, 1946, 1030, 460, 366, 366],
    "apr": [2158, 1615, 808, 341, 281, 281],
}
# Class tables: (grade, subject, pupils) rows as shipped, file order.
CLASSES = {
    "jan": [(5, "Математика", 425), (6, "Математика", 188), (7, "Алгебра", 208), (7, "ТВИС", 2),
            (7, "Геометрия", 82), (8, "Алгебра", 207), (8, "Геометрия", 6), (9, "Алгебра", 91),
            (9, "Геометрия", 3), (10, "Алгебра", 76), (10, "ТВИС", 1), (10, "Геометрия", 5),
            (11, "Алгебра", 78), (11, "Геометрия", 8)],
    "feb": [(5, "Математика", 259), (6, "Математика", 118), (7, "Алгебра", 123), (7, "Геометрия", 39),
            (8, "Геометрия", 18), (8, "Алгебра", 52), (9, "Алгебра", 22), (9, "Геометрия", 4),
            (10, "Алгебра", 30), (10, "Геометрия", 17), (11, "Алгебра", 38), (11, "Геометрия", 14),
            (11, "ТВИС", 1)],
    "mar": [(5, "Математика", 647), (6, "Математика", 327), (7, "Алгебра", 290), (7, "Геометрия", 126), (7, "ТВИС", 1),
            (8, "Геометрия", 155), (8, "Алгебра", 176), (8, "ТВИС", 1), (9, "Алгебра", 115), (9, "Геометрия", 76),
            (10, "Алгебра", 98), (10, "ТВИС", 4), (10, "Геометрия", 77), (11, "Алгебра", 164), (11, "Геометрия", 83)],
    "apr": [(5, "Математика", 523), (6, "Математика", 346), (7, "Алгебра", 230), (7, "Геометрия", 134), (7, "ТВИС", 42),
            (8, "Алгебра", 161), (8, "Геометрия", 72), (8, "ТВИС", 15), (9, "Геометрия", 41), (9, "Алгебра", 104),
            (10, "Алгебра", 93), (10, "ТВИС", 26), (10, "Геометрия", 81), (11, "Геометрия", 45), (11, "Алгебра", 108),
            (11, "ТВИС", 9)],
}
SUBJECT_SUMS = {
    "jan": {"Математика": 613, "Алгебра": 660, "Геометрия": 104, "ТВИС": 3},
    "feb": {"Математика": 377, "Алгебра": 265, "Геометрия": 92, "ТВИС": 1},
    "mar": {"Математика": 974, "Алгебра": 843, "Геометрия": 517, "ТВИС": 6},
    "apr": {"Математика": 869, "Алгебра": 696, "Геометрия": 373, "ТВИС": 92},
}
