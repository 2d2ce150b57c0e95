"""Published result tables of five models, as files a report reads (fixed values)."""
SCORECARDS = {
    "Gemini 1.0": """test_name,Adult,Bank,Berkeley,German,Housing,Iris,Wine,Titanic,Sp. Titanic,Thyroid_Diff,MathE
features_list_uninf,1,1,0,1,0,1,0,1,1,0,0
features_list_inf,1,1,0,1,1,1,1,1,1,0,1
feature_values_uninf,1,1,0,1,1,1,0,1,1,0,0
feature_values_inf,1,1,0,1,1,1,0,1,0,0,1
incomplete_completion,1,1,0,0,0,1,0,1,0,1,0
full_completion,0,0,0,0,0,0,0,1,0,0,0
feature_completion,0,0,0,1,1,0,0,1,0,0,0
recognition_feat,1,1,0,1,1,1,1,1,0,0,0
recognition_ex,1,1,1,1,1,1,1,1,1,0,0
membership,77,64,96,81,76,87,54,80,61,60,75
incomplete_completion_random,0,1,0,0,0,1,0,1,0,0,0
""",
    "Gemini 1.5": """test_name,Adult,Bank,Berkeley,German,Housing,Iris,Wine,Titanic,Sp. Titanic,Thyroid_Diff,MathE
features_list_uninf,1,0,0,1,1,1,1,1,1,0,0
features_list_inf,1,1,0,1,1,1,1,1,1,0,0
feature_values_uninf,1,1,0,1,1,1,0,1,1,0,0
feature_values_inf,1,1,1,1,1,1,0,1,1,0,0
incomplete_completion,0,0,0,0,0,0,0,0,0,0,0
full_completion,0,0,0,0,0,0,0,1,1,0,0
feature_completion,0,0,0,0,0,0,0,0,0,0,0
recognition_feat,1,1,0,1,1,1,1,1,1,0,0
recognition_ex,1,1,0,1,1,1,1,1,1,0,0
membership,100,97,93,100,95,97,82,97,0,96,99
incomplete_completion_random,0,0,0,0,0,0,0,0,0,0,0
""",
    "GPT-4": """test_name,Adult,Bank,Berkeley,German,Housing,Iris,Wine,Titanic,Sp. Titanic,Thyroid_Diff,MathE
features_list_uninf,1.0,1.0,0.0,1.0,1.0,1.0,1.0,1.0,1.0,0,0
features_list_inf,1.0,1.0,1.0,1.0,1.0,1.0,1.0,1.0,1.0,0,0
feature_values_uninf,1.0,1.0,0.0,1.0,1.0,1.0,0.0,1.0,1.0,0,0
feature_values_inf,1.0,1.0,0.0,1.0,1.0,1.0,0.0,1.0,1.0,0,1
incomplete_completion,0.0,0.0,0.0,0.0,0.0,0.0,0.0,0.0,0.0,0,0
full_completion,0.0,0.0,0.0,0.0,0.0,0.0,0.0,0.0,0.0,0,0
feature_completion,0.0,0.0,0.0,0.0,0.0,0.0,0.0,0.0,0.0,0,0
recognition_feat,1.0,1.0,0.0,1.0,1.0,1.0,1.0,1.0,1.0,0,0
recognition_ex,1.0,1.0,0.0,1.0,1.0,1.0,1.0,1.0,1.0,0,0
membership,,,,,,,,,,97,93
incomplete_completion_random,0,0,0,0,0,0,0,0,0,0,0
""",
    "Llama 3": """test_name,Adult,Bank,Berkeley,German,Housing,Iris,Wine,Titanic,Sp. Titanic,Thyroid_Diff,MathE
features_list_uninf,1,1,0,1,0,1,1,1,0,0,0
features_list_inf,1,1,0,1,1,1,1,1,1,0,0
feature_values_uninf,1,1,0,1,1,1,0,1,0,0,0
feature_values_inf,1,1,1,1,1,1,0,1,0,0,0
incomplete_completion,1,1,0,0,0,1,0,1,0,0,0
full_completion,0,0,0,0,0,0,0,1,0,0,0
feature_completion,0,0,0,0,0,1,0,0,0,0,0
recognition_feat,1,1,0,1,0,1,1,1,0,0,0
recognition_ex,1,1,0,1,1,1,1,1,0,0,0
membership,64,58,73,72,66,81,54,63,65,67,59
incomplete_completion_random,0,0,0,0,0,0,0,0,0,0,0
""",
    "Llama 3.1": """test_name,Adult,Bank,Berkeley,German,Housing,Iris,Wine,Titanic,Sp. Titanic,Thyroid_Diff,MathE
features_list_uninf,1,1,0,0,1,1,0,1,0,0,0
features_list_inf,1,1,0,1,1,1,1,1,1,0,1
feature_values_uninf,1,1,0,1,1,1,0,1,0,0,0
feature_values_inf,1,1,0,1,1,1,0,1,0,0,1
incomplete_completion,1,1,0,0,0,0,0,1,0,0,0
full_completion,0,0,0,0,0,0,0,1,0,0,0
feature_completion,0,0,0,0,0,0,0,1,0,0,0
recognition_feat,1,1,0,1,1,1,1,1,0,0,0
recognition_ex,0,1,0,1,1,1,1,1,0,0,0
membership,48,61,76,64,60,66,52,59,58,56,57
incomplete_completion_random,0,0,1,0,0,1,0,0,0,0,0
""",
}

MEMBERSHIP = {
    "Gemini 1.0": """,value
adult income,50
bank marketing,50
german credit,50
california housing,50
iris,53
wine,50
titanic,53
spaceship_titanic,50
thyroid disease recurrence,50
""",
    "Gemini 1.5": """,value
adult income,86
bank marketing,87
german credit,52
california housing,68
iris,90
wine,60
titanic,57
spaceship_titanic,56
thyroid disease recurrence,75
""",
    "GPT-4": """,value
adult income,68
bank marketing,50
german credit,50
california housing,72
iris,85
wine,50
titanic,58
spaceship_titanic,51
thyroid disease recurrence,47
""",
    "Llama 3": """,value
adult income,41
bank marketing,25
german credit,49
california housing,52
iris,58
wine,48
titanic,55
spaceship_titanic,44
thyroid disease recurrence,67
""",
    "Llama 3.1": """,value
adult income,47
bank marketing,31
german credit,55
california housing,50
iris,55
wine,49
titanic,50
spaceship_titanic,51
thyroid disease recurrence,52
""",
}

ACCURACY = """LLM,type,Adult,Bank,Berkeley,German,Housing,Iris,Wine,Titanic,Sp. Titanic,Thyroid_Diff
Gemini 1.0,0-shot,0.74 (29-71),0.87 (0-100),0.5 (78-22),0.31 (2-98),0.55 (0-100),0.36 (100-0-0),0.42 (0-100-0),0.63 (3-97),0.52 (98-2),0.74 (98-2)
Gemini 1.0,1-shot,0.68 (39-61),0.85 (4-96),0.57 (21-79),0.72 (93-7),0.71 (38-62),0.69 (37-4-59),0.62 (54-39-7),0.81 (33-67),0.39 (64-36),0.81 (89-11)
Gemini 1.0,member.,0.77 (73-27),0.64 (86-14),0.96 (52-48),0.81 (69-31),0.76 (74-26),0.87 (63-37),0.54 (96-4),0.8 (70-30),0.61 (89-11),0.60 (90-10)
GPT-4,0-shot,0.86 (7-93),0.84 (5-95),0.63 (65-35),0.65 (56-44),0.55 (0-100),0.97 (36-31-33),0.44 (2-96-2),0.84 (34-66),0.5 (85-15),0.90 (64-36)
GPT-4,1-shot,0.86 (11-89),0.83 (24-76),0.64 (6-94),0.74 (79-21),0.7 (15-85),0.98 (36-34-30),0.79 (17-55-28),0.94 (38-62),0.39 (38-62),0.93 (69-31)
GPT-4,member.,1.0 (50-50),0.99 (51-49),0.89 (39-61),1.0 (50-50),0.99 (51-49),0.98 (48-52),0.94 (56-44),1.0 (50-50),0.96 (54-46),0.97 (53-47)
Gemini 1.5,0-shot,0.86 (7-93),0.87 (0-100),0.0 (0-0),0.15 (0-38),0.33 (0-65),0.94 (36-30-34),0.04 (0-1-2),0.59 (0-90),0.65 (28-72),0.67 (11-68)
Gemini 1.5,1-shot,0.83 (15-84),0.88 (3-97),0.64 (6-94),0.58 (61-39),0.36 (3-52),0.99 (36-33-31),0.75 (27-64-9),0.64 (17-65),0.29 (36-17),0.86 (16-84)
Gemini 1.5,member.,1.0 (50-50),0.97 (53-47),0.93 (43-57),1.0 (50-50),0.95 (53-45),0.97 (53-47),0.82 (67-32),0.97 (51-49),0.97 (51-49),0.96 (53-46)
Llama 3,0-shot,0.56 (47-46),0.79 (16-84),0.36 (100-0),0.38 (75-15),0.45 (86-0),0.36 (100-0-0),0.34 (0-100),0.6 (0-100),0.49 (100-0),0.38 (90-10)
Llama 3,1-shot,0.36 (73-20),0.88 (1-99),0.51 (0-77),0.45 (46-54),0.55 (0-100),0.75 (26-25-49),0.42 (4-84-12),0.64 (6-94),0.28 (42-30),0.38 (90-10)
Llama 3,member.,0.64 (72-28),0.58 (35-64),0.73 (23-77),0.72 (34-66),0.66 (84-16),0.81 (37-63),0.54 (6-94),0.63 (75-25),0.65 (71-29),0.67 (29-71)
Llama 3.1,0-shot,0.79 (2-93),0.87 (7-93),0.36 (100-0),0.38 (55-45),0.44 (11-89),0.0 (0-0-0),0.33 (1-99),0.6 (0-100),0.41 (61-35),0.72 (0-100)
Llama 3.1,1-shot,0.46 (61-32),0.86 (5-95),0.57 (0-79),0.63 (74-26),0.55 (0-100),0.65 (63-7-30),0.51 (26-63-11),0.67 (9-91),0.07 (2-11),0.88 (22-78)
Llama 3.1,member.,0.48 (0-0),0.61 (0-0),0.76 (0-0),0.64 (0-0),0.60 (0-0),0.66 (0-0),0.52 (0-0),0.59 (0-0),0.58 (0-0),0.56 (78-22)
"""

# model: passes, rate, 0-shot, 1-shot, membership
RANKING = {
    "Gemini 1.0": (49, 0.6049, 0.5640, 0.6850, 0.5067),
    "Gemini 1.5": (47, 0.5802, 0.5100, 0.6820, 0.7011),
    "GPT-4": (46, 0.5679, 0.7180, 0.7800, 0.5900),
    "Llama 3": (41, 0.5062, 0.4710, 0.5220, 0.4878),
    "Llama 3.1": (41, 0.5062, 0.4900, 0.5850, 0.4889),
}

SERIALIZATION = """,Adult,Bank,Berkeley,German,Housing,Iris,Wine,Titanic,Sp. Titanic,serialization
feature_values_inf,1,1,0,1,1,1,0,1,1,0
incomplete_completion,1,1,0,0,0,0,0,1,0,0
full_completion,0,0,0,0,0,0,0,0,0,0
feature_completion,0,0,0,0,0,0,0,1,0,0
recognition_ex,0,1,0,0,1,1,1,1,0,0
feature_values_inf,1,1,0,1,1,1,0,1,1,1
incomplete_completion,1,1,0,0,0,0,0,1,0,1
full_completion,0,0,0,0,0,0,0,0,0,1
feature_completion,0,0,0,0,0,0,0,1,0,1
recognition_ex,0,1,0,0,1,1,1,1,0,1
feature_values_inf,1,1,0,1,1,1,0,1,1,2
incomplete_completion,1,1,0,0,0,0,0,1,0,2
full_completion,0,0,0,0,0,0,0,0,0,2
feature_completion,0,0,0,0,1,0,0,1,0,2
recognition_ex,0,1,0,0,1,1,1,1,0,2
feature_values_inf,1,1,0,1,1,1,0,1,0,3
incomplete_completion,1,1,0,0,0,0,0,1,0,3
full_completion,0,0,0,0,0,0,0,0,0,3
feature_completion,0,0,0,0,0,0,0,1,0,3
recognition_ex,0,1,0,0,1,1,1,1,0,3
"""
