"""Fixed values of the published data: catalogue, city order and allowed link hosts.

Jobs take such tables as inputs; these are the ones to pass for the data set the formats were made for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------- fixed values
CITIES = [
    "臺北市", "新北市", "基隆市", "桃園市", "新竹市", "新竹縣", "苗栗縣", "臺中市", "彰化縣", "南投縣", "雲林縣",
    "嘉義市", "嘉義縣", "臺南市", "高雄市", "屏東縣", "宜蘭縣", "花蓮縣", "臺東縣", "澎湖縣", "金門縣", "連江縣",
]
PRODUCTS = [  # product id, id used by the source, group, name, short name
    ("flu", "流感疫苗", "flu", "流感疫苗", "流感疫苗"),
    ("mod_adult", "Moderna_Adult_LP81", "covid", "Moderna LP.8.1(滿12歲以上)", "莫德納 12歲以上"),
    ("mod_child", "Moderna_Child_LP81", "covid", "Moderna LP.8.1(滿6個月未滿12歲)", "莫德納 6個月–11歲"),
    ("novavax", "COVID-19疫苗(Novavax)", "covid", "Novavax JN.1(≧12歲)", "Novavax 12歲以上"),
    ("pcv20", "20價結合型肺炎鏈球菌疫苗", "pcv", "20價結合型肺炎鏈球菌疫苗", "肺鏈 PCV20"),
    ("pcv21", "21價結合型肺炎鏈球菌疫苗", "pcv", "21價結合型肺炎鏈球菌疫苗", "肺鏈 PCV21"),
    ("antiviral", "抗病毒藥劑", "antiviral", "抗病毒藥劑", "流感抗病毒藥劑"),
]
GROUPS = [("flu", "流感疫苗"), ("covid", "COVID-19 疫苗"), ("pcv", "肺炎鏈球菌疫苗"), ("antiviral", "流感抗病毒藥劑")]
LINK_HOSTS = ["gov.tw", "*.gov.tw", "*.gov.taipei", "www.youtube.com", "youtu.be"]
READER_LINK_HOSTS = [*LINK_HOSTS, "gov.taipei"]  # the reading side also accepts the bare city host
MAX_FACILITIES = 20_000
MIN_FACILITIES = 4_000
MAX_PRODUCTS = 50
MAX_GROUPS = 20
# ------------------------------------------------------------------------------


def city_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(CITIES)], "city string, ord int")


def products(spark: SparkSession) -> DataFrame:
    rows = [(p, g, name, short, i) for i, (p, _, g, name, short) in enumerate(PRODUCTS)]
    return spark.createDataFrame(rows, "product_id string, group_id string, name string, short string, ord int")


def product_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(src, p) for p, src, *_ in PRODUCTS], "src_id string, product_id string")


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GROUPS, "group_id string, name string")
