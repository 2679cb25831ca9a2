"""Data contract: column layouts, alias lists, labels and messages.

Everything in this module is a fixed value. The values come from the regulator's file layout and
from the published output tables, and results only match when they are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Raw outage row, one consumer unit (UC) in one outage event, all text, in order.
# ---------------------------------------------------------------------------------------------
EXPORT_LAYOUT = """
PID_INTRP_CONJTO_PIN PID_POSTO_PIN INDIC_AREA_REDE_POSTO_PIN ALIM_INTRP_PIN ESTADO_INTRP ALIM_INTRP CAR_SE
INDIC_INTRP_SE_ALIM NUM_OCORRENCIA_ADMS INDIC_INTRP_AT CONS_INTRP KVA_INTRP NUM_OPER_CHV_INTRP NUM_FUNCAO_ELET_HCAI
DESC_INTRP VALID_POS_OPERACAO DATA_HORA_INIC_INTRP DATA_HORA_FIM_INTRP TIPO_EQP_INTRP COORD_X_INTRP COORD_Y_INTRP
NUM_SEQ_INTRP COD_CAUSA_INTRP COD_COMP_INTRP COD_AREA_ELET_INTRP COD_GRUPO_COMP_INTRP COD_COND_CLIMA_INTRP
COD_TIPO_INTRP INDIC_JUMP_INTRP NUM_PROTOC_JUSTIF_RESP_INTRP TIPO_PROTOC_JUSTIF_INTRP COD_CONJTO_ELET_ANEEL_INTRP
INDIC_CALC_DMIC_INTRP INDIC_PONTO_CONEX_INTRP NUM_GEO_CHV_INTRP TIPO_REDE_CHV_INTRP TIPO_CHV_INTRP
INDIC_PROPR_POSTO_INTRP TENSAO_OPER_ALIM_INTRP INDIC_DESLIG_ENT_SERV_INTRP INDIC_PROPR_CHVP_INTRP
INDIC_CHVP_INIC_ALIM_INTRP PID PID_INTRP_UCI NUM_INTRP_UCI NUM_POSTO_UCI NUM_UC_UCI TIPO_SIT_UC_UCI
DTHR_INICIO_INTRP_UC NUM_INTRP_INIC_MANOBRA_UCI NUM_MOTIVO_TRAT_DIF_UCI UC_ACESSANTE SIGLA_REGIONAL
NUM_PROTOC_JUSTIF_RESP_UCI TIPO_PROTOC_JUSTIF_UCI PID_PIN INDIC_PROCES_IND_PIN INDIC_SIT_PROCES_INDIC_UCI
""".split()

# Fixed value: identity of a raw row.
RECORD_KEY = ["NUM_INTRP_UCI", "NUM_POSTO_UCI", "NUM_UC_UCI"]

# The event attributes (42 columns) and the UC attributes (18 columns) of a raw row.
EVENT_COLUMNS = [c for c in EXPORT_LAYOUT[: EXPORT_LAYOUT.index("PID") + 1] if c != "PID_POSTO_PIN"]
UC_COLUMNS = """
PID_INTRP_UCI NUM_INTRP_UCI NUM_POSTO_UCI NUM_UC_UCI TIPO_SIT_UC_UCI DTHR_INICIO_INTRP_UC NUM_INTRP_INIC_MANOBRA_UCI
NUM_MOTIVO_TRAT_DIF_UCI UC_ACESSANTE SIGLA_REGIONAL NUM_PROTOC_JUSTIF_RESP_UCI TIPO_PROTOC_JUSTIF_UCI PID_PIN
INDIC_PROCES_IND_PIN INDIC_SIT_PROCES_INDIC_UCI DATA_HORA_FIM_INTRP PID_POSTO_PIN COD_AREA_ELET_INTRP
""".split()

# Regions, their one-letter codes, labels used when a region or code is missing.
REGION_BY_LETTER = {"P": "CSL", "L": "NRT", "M": "NRO", "C": "LES", "V": "OES"}
REGIONS = ["CSL", "LES", "NRO", "NRT", "OES"]
SERVER_BY_REGION = {"CSL": "SODPGO", "NRT": "SODLNA", "NRO": "SODMGA", "LES": "SODCTA", "OES": "SDOCEL"}
COMPANY = "COPEL"
COMPANY_TITLE = "Copel"
NO_REGION = "SEM_REGIONAL"
NO_PROTOCOL = "SEM_PROTOCOLO"
NO_SET = "SEM_CONJUNTO"

# Eligible / cancelled event state, differential-treatment reason.
STATE_ELIGIBLE = "4"
STATE_CANCELLED = "7"
REASON_OVERLAP = "91"

# Fixed value: label of the net rule written next to each indicator.
NET_RULE = (
    "ESTADO_4_DURACAO_MAIOR_IGUAL_3_PROTOCOLO_0_MOTIVO_NULO_"
    "INDIC_SIT_PROCES_INDIC_NULO_FATURADA_FIC_SEM_MANOBRA_INICIAL"
)

# Source and formula labels.
DENOMINATOR_BILLED = "IQS_CONSUMIDOR_FATURADO_REGIONAL"
DENOMINATOR_CONSUMERS = "IQS_CONSUMIDORES_REGIONAL"
DENOMINATOR_DISTINCT = "COUNT_DISTINCT_NUM_UC_UCI"
BILLED_APPLIED = "APLICADO_UC_FATURADA_HCAI"
BILLED_SKIPPED = "NAO_APLICADO"
BILLED_BAD_COLUMNS = "NAO_APLICADO_COLUNAS_INVALIDAS"
FORMULA_V2 = "ESTIMATIVA_PRODIST_VRC_KEI_MAIOR_COMPENSACAO_UC"
FORMULA_V2_NO_VRC = "SEM_VRC_FORMULA_FINANCEIRA_INCOMPLETA"
FORMULA_V1_VRC = "ESTIMATIVA_OPERACIONAL_EXCEDENTE_X_VRC"
FORMULA_V1_VALUE = "ESTIMATIVA_OPERACIONAL_EXCEDENTE_X_VALOR_REFERENCIA"
FORMULA_V1_NONE = "SEM_VALOR_REFERENCIA_FORMULA_OFICIAL_PENDENTE"
NET_CRITERION = "LIQUIDO_PRE_CALCULADO_EM_INDICADORES_UC"

# Compensation formula.
HOURS_IN_MONTH = 730.0
KEI_HIGH, KEI_MEDIUM, KEI_LOW = 108, 40, 34
KEI_HIGH_LEVELS = ["1", "2", "3"]
KEI_MEDIUM_LEVELS = ["3a", "3A", "4", "S"]

# System messages.
MSG_NEGATIVE = "Duração negativa em interrupção distinta. UCs afetadas: "
MSG_DEVICE = "Sobreposição temporal no mesmo equipamento. Manter menor NUM_SEQ_INTRP. UCs afetadas: "
MSG_UC = (
    "UC com interrupção contida em outra interrupção da mesma UC e mesmo protocolo. NUM_SEQ que contém: "
)
MSG_CODES = "Interrupção sem causa ou componente. UCs afetadas: "
MSG_CONTAINED = (
    "Interrupção contida temporalmente em outra do mesmo NUM_OPER_CHV_INTRP; "
    "sugerir ESTADO_INTRP=7 e NUM_MOTIVO_TRAT_DIF_UCI=91."
)
MSG_NOT_CONTAINED = "Interrupção não contida por outra do mesmo NUM_OPER_CHV_INTRP."
MSG_UC_CONTAINED = (
    "UC com janela de interrupção contida em outra interrupção da mesma UC e mesmo protocolo."
)
MSG_UC_TRIM = (
    "Interseção temporal parcial na mesma UC e mesmo protocolo; ajustar início do registro alvo "
    "para fim da interrupção anterior."
)
MSG_REMOVED_NEGATIVE = "DATA_HORA_FIM_INTRP menor que DATA_HORA_INIC_INTRP."
MSG_REMOVED_CODES = "COD_CAUSA_INTRP ou COD_COMP_INTRP nulo/vazio."
MSG_REMOVED_OVERLAP = (
    "NUM_SEQ_INTRP sugerida para exclusão por sobreposição de interrupção/equipamento."
)
MSG_OUTLIER = (
    "Interrupção com duração acima de {} horas. Não alterar automaticamente; "
    "avaliar causa, componente, horários e protocolo."
)
MSG_SUGGEST_START = "Sugerir ajuste de fuso: fim = início + 3 horas."
MSG_SUGGEST_END = "Sugerir DATA_HORA_FIM_INTRP + 3 horas por provável fuso horário."
MSG_MANUAL = "Revisão manual: diferença negativa maior que 3 horas."
MSG_DEVICE_PAIR = "Sobreposição temporal no mesmo NUM_OPER_CHV_INTRP. Manter menor NUM_SEQ_INTRP."
MSG_SHIFT_EVENT = (
    "Deslocar início da segunda interrupção para o fim da primeira e preencher NUM_INTRP_INIC_MANOBRA_UCI."
)
MSG_SHORT_EVENT = (
    "Interrupção curta sobreposta: sugerir exclusão/tratamento diferenciado com motivo 91."
)
MSG_SHIFT_UC = (
    "Deslocar início da segunda interrupção da UC para o fim da primeira e preencher "
    "NUM_INTRP_INIC_MANOBRA_UCI."
)
MSG_SHORT_UC = (
    "Interrupção curta sobreposta da UC: sugerir exclusão/tratamento diferenciado com motivo 91."
)
MSG_REVIEW_CODES = (
    "Revisar causa/componente com base em descrição, tipo de equipamento e histórico de ocorrências similares."
)

# Accepted column names, best first.
ALIASES = {
    "billed": {
        "uc": ["uc", "NUM_UC_HCAI", "NUM_UC_UCI", "NUM_UC"],
        "faturado": ["faturado", "INDIC_FAT_HCAI", "INDIC_FAT"],
        "regional": ["regional", "REGIONAL", "REGIONAL_ORIGEM"],
    },
    "denominators": {
        "regional_origem": [
            "REGIONAL_TOTAL", "REGIONAL_ORIGEM", "SIGLA_REGIONAL", "REGIONAL", "DSC_REGIONAL", "NOME_REGIONAL",
        ],
        "quantidade_ucs": [
            "UC_faturada", "QTD_UC", "QTD_UCS", "QUANTIDADE_UCS", "CONSUMIDORES", "TOTAL", "QTDE", "UC",
        ],
    },
    "indicators": {
        "uc": ["uc", "num_uc_uci", "isn_uc"],
        "regional": ["regional", "regional_origem"],
        "cenario": ["cenario", "fonte", "base"],
        "dic_horas": ["dic_horas", "realizado_dic"],
        "fic": ["fic", "fic_qtd", "realizado_fic"],
        "dmic_horas": ["dmic_horas", "realizado_dmic"],
    },
    "targets": {
        "uc": [
            "uc", "ISN_UC", "NUM_UC", "NUM_UC_UCI", "NUM_UC_HCAI", "NUM_CONTA_CONTRATO", "CONTA_CONTRATO",
            "COD_UC", "ID_UC", "U_C",
        ],
        "limite_dic_horas": ["META_DIC", "DIC_MENSAL", "LIMITE_DIC", "DIC_LIMITE", "DIC_META", "limite_dic_horas", "DIC"],
        "limite_fic": ["META_FIC", "FIC_MENSAL", "LIMITE_FIC", "FIC_LIMITE", "FIC_META", "FIC"],
        "limite_dmic_horas": [
            "META_DMIC", "DMIC_MENSAL", "LIMITE_DMIC", "DMIC_LIMITE", "DMIC_META", "limite_dmic_horas", "DMIC",
        ],
        "conjunto_aneel": ["COD_CONJUNTO_ANEEL", "cea", "COD_CONJTO_ELET_ANEEL_INTRP", "CONJUNTO"],
        "ano_ref": ["ANO_REF", "ANO", "ANO_REFERENCIA"],
        "urb_rur": ["URB_RUR"],
        "grupo_tensao": ["COD_GRUPO_NTFN", "COD_GRUPO_NIVEL_TENSAO_UC", "grupo_tensao"],
        "nivel_tensao": ["COD_NTFN", "COD_NIVEL_TENSAO_UC", "nivel_tensao"],
        "valor": [
            "VRC", "EUSD_MEDIO", "EUSD_MEDIA", "VALOR_EUSD", "VL_EUSD", "VALOR_REFERENCIA", "VL_REFERENCIA",
        ],
    },
    "vrc": {
        "uc": ["ISN_UC", "uc", "NUM_UC", "NUM_UC_UCI", "NUM_UC_HCAI"],
        "conjunto_aneel": ["cea", "NUM_CONJTO_ANEEL_FIXO_UC", "COD_CONJUNTO_ANEEL"],
        "urb_rur": ["urb_rur", "INDIC_LOCAL_TEC_UC"],
        "grupo_tensao": ["COD_GRUPO_NIVEL_TENSAO_UC", "grupo_tensao"],
        "nivel_tensao": ["COD_NIVEL_TENSAO_UC", "nivel_tensao"],
        "vrc": ["VRC", "VAL_BASE_CALC_COMPEN_UC", "VALOR_VRC"],
    },
    "consumers": {
        "regional": ["regional", "regiao", "sigla_regional", "arquivo_origem"],
        "consumidores": ["consumidores", "consumidor", "qtd_consumidores", "total_consumidores", "uc_total"],
        "mes": ["mes", "mes_referencia", "competencia_mes"],
    },
    "billed_list": {"uc": ["UC_FATURADAS", "NUM_UC_HCAI", "NUM_UC_UCI", "UC", "NUM_UC"]},
}

# Consumers per region used when no consumer file is given (regional, consumidores, mes).
DEFAULT_CONSUMERS = [
    ("CSL", 607891, 4),
    ("LES", 17781002, 4),
    ("NRO", 926116, 4),
    ("NRT", 950494, 4),
    ("OES", 1019621, 4),
]

# Upper limit of the set's DEC/FEC (None = no limit) -> target per UC, by voltage class
# and urban/rural. "AT" = group A levels 1,2,3; "MT" = group A levels 3a,4,S; "BT" = group B.
VOLTAGE_CLASSES = {"AT": ("A", ["1", "2", "3"]), "MT": ("A", ["3a", "4", "S"]), "BT": ("B", None)}
TARGET_BANDS = {
    "META_DIC": ("limite_dec", {
        ("AT", "U"): [(None, 3)],
        ("AT", "R"): [(None, 5)],
        ("MT", "U"): [(5, 3), (10, 5), (15, 7), (20, 9), (25, 10), (None, 12)],
        ("MT", "R"): [(5, 8), (10, 13), (15, 19), (20, 24), (25, 28), (40, 33), (None, 37)],
        ("BT", "U"): [(5, 4), (10, 7), (15, 10), (20, 12), (25, 14), (40, 15), (50, 18), (None, 21)],
        ("BT", "R"): [(5, 10), (10, 16), (15, 20), (20, 24), (25, 28), (40, 33), (None, 40)],
    }),
    "META_FIC": ("limite_fec", {
        ("AT", "U"): [(None, 2)],
        ("AT", "R"): [(None, 4)],
        ("MT", "U"): [(5, 3), (10, 4), (15, 5), (20, 6), (25, 6), (None, 7)],
        ("MT", "R"): [(5, 4), (10, 5), (15, 7), (20, 8), (25, 9), (40, 10), (None, 11)],
        ("BT", "U"): [(5, 3), (10, 4), (15, 5), (20, 6), (25, 7), (40, 7), (50, 8), (None, 9)],
        ("BT", "R"): [(5, 4), (10, 6), (15, 7), (20, 8), (25, 9), (40, 10), (None, 12)],
    }),
    "META_DMIC": ("limite_dec", {
        ("AT", "U"): [(None, 2)],
        ("AT", "R"): [(None, 4)],
        ("MT", "U"): [(5, 3), (10, 5), (15, 6), (20, 7), (25, 8), (None, 8)],
        ("MT", "R"): [(5, 6), (10, 10), (15, 14), (20, 18), (25, 20), (40, 24), (None, 24)],
        ("BT", "U"): [(5, 3), (10, 5), (15, 7), (20, 9), (25, 10), (40, 12), (50, 12), (None, 12)],
        ("BT", "R"): [(5, 8), (10, 12), (15, 15), (20, 18), (25, 20), (40, 24), (None, 24)],
    }),
}
# Targets that depend on the class only; here the medium class is group A levels 4,5.
CLASS_TARGETS = {
    "META_DICRI": [("A", ["4", "5"], "U", 8.0), ("A", ["4", "5"], "R", 21.0), ("B", None, "U", 13.0),
                   ("B", None, "R", 21.0), ("A", ["1", "2", "3"], None, 0.001)],
    "META_DISE": [("A", ["4", "5"], "U", 24.0), ("A", ["4", "5"], "R", 48.0), ("B", None, "U", 24.0),
                  ("B", None, "R", 48.0), ("A", ["1", "2", "3"], None, 0.001)],
}
TARGET_INDICATOR_DEC, TARGET_INDICATOR_FEC, TARGET_MONTH = 13, 14, 12
ACTIVE_UC_STATES = ["LG", "CR"]

# Working layout <- column of the historic integration table.
HISTORY_LAYOUT = {
    "PID_INTRP_CONJTO_PIN": "PID_OCOR_INTRP_ULT_HIADMS",
    "PID_POSTO_PIN": "PID_POSTO_PIN_PRIM_HIADMS",
    "INDIC_AREA_REDE_POSTO_PIN": "INDIC_AREA_REDE_POSTO_PIN_PRIM_HIADMS",
    "ALIM_INTRP_PIN": "NUM_ALIM_INTRP_PIN_PRIM_HIADMS",
    "ESTADO_INTRP": "ESTADO_INTRP_ULT_HIADMS",
    "ALIM_INTRP": "ALIM_INTRP_PRIM_HIADMS",
    "CAR_SE": "CAR_SE_INTRP_PRIM_HIADMS",
    "INDIC_INTRP_SE_ALIM": "INDIC_INTRP_SE_ALIM_INTRP_ULT_HIADMS",
    "NUM_OCORRENCIA_ADMS": "PID_OCOR_INTRP_ULT_HIADMS",
    "INDIC_INTRP_AT": "INDIC_INTRP_AT_INTRP_ULT_HIADMS",
    "CONS_INTRP": "CONS_INTRP_PRIM_HIADMS",
    "KVA_INTRP": "KVA_INTRP_PRIM_HIADMS",
    "NUM_OPER_CHV_INTRP": "NUM_OPER_CHV_INTRP_ULT_HIADMS",
    "NUM_FUNCAO_ELET_HCAI": "NUM_FUNCAO_ELET_INTRP_PRIM_HIADMS",
    "DESC_INTRP": None,
    "VALID_POS_OPERACAO": "INDIC_VALID_POS_OPER_INTRP_ULT_HIADMS",
    "DATA_HORA_INIC_INTRP": "DATA_HORA_INIC_INTRP_ULT_HIADMS",
    "DATA_HORA_FIM_INTRP": "DATA_HORA_FIM_INTRP_ULT_HIADMS",
    "TIPO_EQP_INTRP": "TIPO_EQP_INTRP_PRIM_HIADMS",
    "COORD_X_INTRP": "COORD_X_INTRP_PRIM_HIADMS",
    "COORD_Y_INTRP": "COORD_Y_INTRP_PRIM_HIADMS",
    "NUM_SEQ_INTRP": "NUM_SEQ_INTRP_CHVP_HIADMS",
    "COD_CAUSA_INTRP": "COD_CAUSA_INTRP_ULT_HIADMS",
    "COD_COMP_INTRP": "COD_COMP_INTRP_ULT_HIADMS",
    "COD_AREA_ELET_INTRP": "COD_AREA_ELET_INTRP_ULT_HIADMS",
    "COD_GRUPO_COMP_INTRP": "COD_GRUPO_COMP_INTRP_ULT_HIADMS",
    "COD_COND_CLIMA_INTRP": "COD_COND_CLIMA_INTRP_ULT_HIADMS",
    "COD_TIPO_INTRP": "COD_TIPO_INTRP_ULT_HIADMS",
    "INDIC_JUMP_INTRP": "INDIC_JUMP_INTRP_ULT_HIADMS",
    "NUM_PROTOC_JUSTIF_RESP_INTRP": "NUM_PROTOC_JUSTIF_RESP_INTRP_ULT_HIADMS",
    "TIPO_PROTOC_JUSTIF_INTRP": "TIPO_PROTOC_JUSTIF_INTRP_ULT_HIADMS",
    "COD_CONJTO_ELET_ANEEL_INTRP": "COD_CONJTO_ELET_ANEEL_INTRP_PRIM_HIADMS",
    "INDIC_CALC_DMIC_INTRP": "INDIC_CALC_DMIC_INTRP_ULT_HIADMS",
    "INDIC_PONTO_CONEX_INTRP": "INDIC_PONTO_CONEX_INTRP_PRIM_HIADMS",
    "NUM_GEO_CHV_INTRP": "NUM_GEO_CHV_INTRP_PRIM_HIADMS",
    "TIPO_REDE_CHV_INTRP": "TIPO_REDE_CHV_INTRP_PRIM_HIADMS",
    "TIPO_CHV_INTRP": "TIPO_CHV_INTRP_PRIM_HIADMS",
    "INDIC_PROPR_POSTO_INTRP": "INDIC_PROPR_POSTO_INTRP_PRIM_HIADMS",
    "PID_INTRP_UCI": "NUM_SEQ_INTRP_CHVP_HIADMS",
    "NUM_INTRP_UCI": "NUM_SEQ_INTRP_CHVP_HIADMS",
    "NUM_POSTO_UCI": "PID_POSTO_PIN_PRIM_HIADMS",
    "NUM_UC_UCI": "NUM_UC_UCI_CHVP_HIADMS",
    "TIPO_SIT_UC_UCI": "TIPO_SIT_UC_UCI_PRIM_HIADMS",
    "DTHR_INICIO_INTRP_UC": "DATA_HORA_INIC_INTRP_ULT_HIADMS",
    "NUM_INTRP_INIC_MANOBRA_UCI": "NUM_INTRP_INIC_MANOBRA_UCI_ULT_HIADMS",
    "NUM_MOTIVO_TRAT_DIF_UCI": "NUM_MOTIVO_TRAT_DIF_UCI_ULT_HIADMS",
    "UC_ACESSANTE": "INDIC_UC_ACESS_UCI_PRIM_HIADMS",
    "SIGLA_REGIONAL": "SIGLA_REGIONAL_INTRP_PRIM_HIADMS",
    "NUM_PROTOC_JUSTIF_RESP_UCI": "NUM_PROTOC_JUSTIF_RESP_UCI_ULT_HIADMS",
    "TIPO_PROTOC_JUSTIF_UCI": "TIPO_PROTOC_JUSTIF_UCI_ULT_HIADMS",
    "PID_PIN": "PID_PIN_PRIM_HIADMS",
    "INDIC_PROCES_IND_PIN": "INDIC_PROCES_IND_PIN_ULT_HIADMS",
    "INDIC_SIT_PROCES_INDIC_UCI": "INDIC_SIT_PROCES_INDIC_UCI_ULT_HIADMS",
    "PID": "PID_OCOR_INTRP_ULT_HIADMS",
}
HISTORY_LOADED_AT = "DTHR_INC_REGIS_HIADMS"
HISTORY_FILE = "NOME_ARQ_ADMS_HIADMS"

# File names and formats.
OUTAGE_FILE_PATTERN = r"(?i)Interrupcoes_IQS_(\d{14})_([A-Za-z]{3})\.csv$"
CSV_SEPARATOR = "|"

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in EXPORT_LAYOUT])

CSV_LOG_SCHEMA = T.StructType([
    T.StructField("arquivo_path", T.StringType()),
    T.StructField("arquivo_nome", T.StringType()),
    T.StructField("arquivo_tamanho_bytes", T.LongType()),
    T.StructField("arquivo_modificado_em", T.TimestampType()),
    T.StructField("anomes", T.StringType()),
    T.StructField("processado_em", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("linhas_lidas", T.LongType()),
    T.StructField("mensagem_erro", T.StringType()),
])

STEP_LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("anomes", T.StringType()),
    T.StructField("ordem", T.IntegerType()),
    T.StructField("etapa", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("mensagem", T.StringType()),
    T.StructField("registrado_em", T.StringType()),
])

# Decision -> validation status it sets, roles whose change requests apply at once.
DECISIONS = {
    "validar": ("aplicado", True, "validado"),
    "rejeitar": ("aplicado", False, "rejeitado"),
    "ignorar_regra": ("aplicado", False, "ignorado"),
    "aprovar_alteracao": ("aprovado", False, "em_analise"),
    "rejeitar_alteracao": ("rejeitado", False, "em_analise"),
}
BATCH_DECISIONS = ["validar", "rejeitar", "ignorar_regra"]
APPLYING_ROLES = ["admin", "gestor"]

ISSUE_COLUMNS = [
    "regra", "gravidade", "grao", "chave_evento", "chave_registro", "num_seq_intrp", "num_intrp_uci",
    "num_oper_chv_intrp", "num_posto_uci", "num_uc_uci", "regional_origem", "campo_sugerido",
    "valor_original", "valor_sugerido", "acao_sugerida", "status_pendencia", "justificativa_sistema",
    "criado_em",
]
