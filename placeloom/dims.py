"""Closed domains and word lists.

Everything in this file is a FIXED VALUE: results depend on these exact
strings and numbers, so they are listed plainly and kept in one place.
"""

# ---- fixed values: categories, cities, districts --------------------------
CATEGORIES = ["图书馆", "食堂", "自然"]
ALL_CATEGORIES = "全部"

SHANGHAI_DISTRICTS = [
    "浦东新区", "黄浦区", "徐汇区", "长宁区", "静安区", "普陀区", "虹口区", "杨浦区",
    "闵行区", "宝山区", "嘉定区", "金山区", "松江区", "青浦区", "奉贤区", "崇明区",
]
SUZHOU_DISTRICTS = [
    "姑苏区", "虎丘区", "吴中区", "相城区", "吴江区", "苏州工业园区", "苏州高新区",
    "常熟市", "张家港市", "昆山市", "太仓市",
]
JIAXING_DISTRICTS = ["南湖区", "秀洲区", "嘉善县", "海盐县", "海宁市", "平湖市", "桐乡市", "嘉兴经开区"]
NANTONG_DISTRICTS = [
    "崇川区", "通州区", "海门区", "海安市", "如东县", "启东市", "如皋市",
    "南通开发区", "通州湾示范区", "苏锡通园区",
]
WUXI_DISTRICTS = ["梁溪区", "锡山区", "惠山区", "滨湖区", "新吴区", "江阴市", "宜兴市", "无锡经开区"]
ZHENJIANG_DISTRICTS = ["京口区", "润州区", "丹徒区", "镇江新区", "丹阳市", "扬中市", "句容市"]
DISTRICTS = (
    SHANGHAI_DISTRICTS + SUZHOU_DISTRICTS + JIAXING_DISTRICTS
    + NANTONG_DISTRICTS + WUXI_DISTRICTS + ZHENJIANG_DISTRICTS
)
DISTRICT_ALIASES = {"苏州高新区": "虎丘区"}
CITIES = ["上海", "苏州", "嘉兴", "南通", "无锡", "镇江"]
CITY_PREFIXES = {
    "上海": ["上海市"], "苏州": ["苏州市", "苏州高新区"], "嘉兴": ["嘉兴市"],
    "南通": ["南通市"], "无锡": ["无锡市"], "镇江": ["镇江市"],
}

# ---- fixed values: bounding boxes (south, north, west, east) ---------------
CITY_BOXES = {
    "上海": (30.6, 31.9, 120.8, 122.2),
    "苏州": (30.7, 32.1, 119.8, 121.3),
    "嘉兴": (30.25, 31.05, 120.3, 121.35),
    "南通": (31.55, 32.75, 120.2, 122.05),
    "无锡": (31.05, 32.1, 119.45, 120.75),
    "镇江": (31.55, 32.4, 118.9, 119.95),
}
VISIT_SHANGHAI_BOX = (30.65, 31.9, 120.85, 122.25)

# ---- fixed values: numbers --------------------------------------------------
EARTH_RADIUS_M = 6371000.0
DEFAULT_PAGE, MAX_PAGE = 200, 500
PHOTO_QUOTA_NATURE, PHOTO_QUOTA_OTHER = 10, 5
ONSITE_HOURS = "以现场公示为准"
NOTE_CUTOFF = "2022-01-01T00:00:00+08:00"
CITY_QUOTAS = {"苏州市": 120, "南通市": 70, "无锡市": 90, "嘉兴市": 70, "镇江市": 60}
IMAGE_CHANNELS = ["baidu-images", "sogou-images", "bing-images", "360-images"]

# ---- fixed values: name rules -----------------------------------------------
SCHOOL = "大学|学院|学校|校区|小学|中学|初中|高中|幼儿园|九年一贯制|十二年一贯制|中等职业|职校|技校"
INSTITUTION = (
    "机关|政府(?!路)|委员会|管理局|税务局|公安局|检察院|法院|公司|集团|银行|医院|部队|军队|协会|商会|工会|企业|职工"
)
EXCLUDED_NAME = "阅闲坊"
EXCLUDED_ROOM = "书房|图书室|阅读空间|借阅点|流动图书"
EXCLUDED_PARTY = "党群|党建"
CANTEEN_ALLOW = {
    "quality": "社区|长者|老年|市民|邻里|睦邻|天平里|天平新里|众乐山|食尚书舍|助餐(?:点|中心|服务|食堂)",
    "admin": "社区|长者|老年|市民|邻里|天平里|天平新里|众乐山|食尚书舍|助餐(?:点|服务|食堂)",
}
CANTEEN_DENY = "自选大食堂|自助大食堂"
NATURE_ALLOW = (
    "公园|绿地|绿廊|生态走廊|生态廊道|风光带|景观带|滨水空间|滨江|滨河|湖滨|河畔|湿地|森林|游园|生态园|风景区|景区|"
    "步道|绿道|花谷|绿洲|绿岛|花园|植物园|园(?:（.*）)?$|苑$|湾$|广场$|圃$|堤$|(?:山|湖|岛|洲|滩|谷|岭|峰)$"
)
NATURE_FREE_NAMES = (
    "^(?:竖新会客厅|桂江路[三四]期|浏缘|梅馨陇韵|美树里|龙游河三期|匠心筑缘|五山片区|濠西书苑休闲区|福巷)$"
)
NATURE_DENY = "小区|住宅|校园|单位内部|高尔夫|私家|市政隔离带|道路中央绿带"
ADDRESS_LOCATOR = (
    r"(?:花园|宅)\d+号|村[^,，]*\d+(?:组[^,，]*\d+)?号|(?:路|街|弄).*(?:交叉口|地铁站).{0,12}\d+米|"
    r"(?:地铁|轨交).{0,30}(?:站|口)|"
    r"(?:小区|花园|公寓|大楼|大厦|中心|广场|菜市场|园区|邻里中心).*(?:门|楼|层|旁).{0,12}(?:\d+米)?|"
    r"(?:村|苑|酒店|园|城|工业区).{0,20}(?:门|旁).{0,10}(?:\d+米)?"
)
NATURE_LOCATOR = (
    "路|街|巷|弄|大道|公路|村|镇|乡|园|苑|湖|河|浜|港|桥|交叉口|路口|转角|东至|南至|西至|北至|沿线|沿岸|旁|侧|段"
)

# ---- fixed values: address patterns -----------------------------------------
ROAD_NUMBER = (
    r"([^区县\d,，/()（）]{1,30}(?:公路|大道|路|街|道|弄|巷|村|里))\s*(\d+)"
    r"(?:\s*[-—至到]\s*(\d+))?(?:\s*弄\s*(\d+))?\s*号?"
)
ROAD_NUMBER_NEW_CITY = r"([一-鿿]{1,12}(?:公路|大道|路|街|巷|弄|里))\s*(\d+(?:-\d+)?)号?"
STREET_NUMBER = r"([一-龥·]+(?:路|街|道|公路|大道))(\d+)号"
STREET_TOKEN = r"[一-鿿]{1,16}(?:路|街|巷|弄|大道)\d+(?:弄\d+)?号"
CITY_PREFIX = "^(?:上海|苏州|嘉兴|南通|无锡|镇江)市?"
CITY_START = "^(?:上海市|苏州市|嘉兴市|南通市|无锡市|镇江市)"
ADDRESS_PROSE = "毗邻|地处|位于|核心地区|东至|西至|南至|北至|用地面积|占地面积|沿线|区域内"
ADDRESS_PLACE = "路|街|巷|弄|道|公路|大道|镇|乡|村|浜|堤|岛|景区|园区|交叉口|交汇处|路口"
PROBLEM_PROSE = "面积|毗邻|核心地区|东至|西至|南至|北至|位于"
PROBLEM_LOCATOR = "路|街|巷|弄|道|镇|村|浜|堤|公路"
SUBORDINATE_POI = (
    "停车场|停车点|管理中心|生活区|办公区|公厕|卫生间|洗手间|出入口|入口|售票处|游客中心|码头|公交站|地铁站|充电站|"
    "服务中心|警务室|驿站|商店|餐厅|咖啡"
)
RESIDENTIAL = "小区|住宅|社区|公寓|家园|花园"

# ---- fixed values: map-discovery cascade ------------------------------------
CORE_TYPE = (
    "公园$|湿地$|森林$|植物园$|风景区$|景区$|绿地$|绿廊$|风光带$|滨水空间$|绿道$|步道$|生态园$|"
    "湖$|山$|岛$|洲$|滩$|谷$|岭$|峰$|堤$"
)
REJECT_NAME = (
    "(?:东|西|南|北|侧|号)?门$|入口|出口|停车|公交|地铁|游客中心|管理|售票|服务处|驿站|充电|酒店|宾馆|饭店|餐|咖啡|茶|"
    "酒吧|会所|公司|集团|医院|学校|学院|大学|幼儿园|小区|住宅|花苑|家园|新城|社区|物业|商厦|商场|超市|银行|市场|"
    "农庄|农业|果园|采摘|垂钓|渔业|草莓|葡萄|农场|乐园|动物园|水世界|婚庆|民宿|营地|露营|拓展|团建|"
    "纪念馆|博物馆|寺|庙|塔|洞|泉|亭|桥|雕塑|广场店|管理站|交叉口|道路|大道$|公路$|路$|街$|村$|"
    "建设中|暂停开放|内部|高尔夫|墓|陵园|公墓|主题馆|展览|观光车|码头|厕所|卫生间|卖品部|检票"
)
PRIVATE_PLANT = (
    "多肉植物园|食虫植物园|花木植物园|观赏植物园|名贵植物园|草药植物园|中草药植物园|恭喜发财植物园|漫生活植物园|"
    "热带植物园|芳香植物园|古樟植物园|水八仙植物园|沙生植物园|药用植物园"
)
NATURAL_SCENIC = "山|湖|河|江|海|港|湾|岛|洲|滩|湿地|森林|花谷|植物|公园|绿地|绿廊|风光带|滨水"
SUB_POI = (
    "[-—](?!一期|二期|三期|四期)|(?:公园|景区|植物园|湿地|森林|绿道|步道)内|"
    "[（(](?:东|西|南|北|东北|西北|东南|西南)?(?:门|入口|出口|停车|地铁)"
)

# ---- fixed values: evidence and source vocabulary ----------------------------
FACILITY_TERMS = [
    "wifi", "wi-fi", "无线网", "插座", "电源", "充电", "厕所", "卫生间", "洗手间",
    "饮水", "热水", "茶水", "存包", "储物柜", "打印", "复印", "电梯", "无障碍",
    "停车", "母婴", "空调", "一楼", "二楼", "三楼", "四楼", "五楼", "六楼",
    "七楼", "八楼", "九楼", "十楼", "b1", "地下一层", "座位", "桌位",
    "席位", "儿童区", "少儿区", "母婴室", "咖啡", "餐厅", "微波炉",
    "健身房", "活动室", "电脑", "计算机", "自助借还", "消毒机", "露台",
    "休息室", "影音", "电影",
]
FIELD_TERMS = [
    "地址", "开放时间", "营业时间", "服务时间", "wifi", "无线", "插座", "电源",
    "充电", "厕所", "卫生间", "饮水", "热水", "楼层", "电梯", "无障碍", "停车",
    "实景", "照片", "图片",
]
SOURCE_TERMS = ["小红书", "大众点评", "高德", "百度地图", "政府", "官方", "图书馆", "文旅"]
TIME_CONTEXT = "开放时间|营业时间|服务时间|供餐时间|周[一二三四五六日天]|每天|每日|上午|下午|早餐|午餐|晚餐"
TIME_VALUE = r"(?:[01]?\d|2[0-4])\s*[:：]\s*[0-5]\d"
ADDRESS_CONTEXT = "地址|位于|坐落|设在|地处|入口"
ADDRESS_VALUE = "路|街|道|巷|弄|号|楼|层|室|中心|广场|大厦|园区"
HOURS_ASSERTION = r"(?:开放时间|营业时间|服务时间|供餐时间)[^。；;\n]{0,80}(?:[01]?\d|2[0-4])\s*[:：]\s*[0-5]\d"
ADDRESS_ASSERTION = (
    r"(?:地址|位于|坐落|设在|地处)[^。；;\n]{0,120}(?:路|街|道|巷|弄|号|楼|层|室|中心|广场|大厦|园区)"
)
FACILITY_ASSERTION = (
    "有|无|没有|未设|不设|不提供|配有|配置|提供|支持|可以|可用|可使用|位于|入口|在.{0,12}(?:楼|层)|分布在"
)
PAGE_NOISE = "相关搜索|大家还在搜|意见反馈|登录查看|搜索工具|热搜榜|ICP备|隐私政策"
SEARCH_NOISE = (
    "百度为您找到|百度一下|去掉.*获得更多|搜索结果|推荐您搜索|看看元宝|问题分析中|百度图片|时间不限所有网页|买燃油车|电动汽车|延长壳牌"
)
EXCLUDED_DOMAINS = [
    "baidu.com", "sogou.com", "google.com", "bing.com", "miit.gov.cn", "fankui.sogou.com", "yuanbao.tencent.com",
]
TRACKING_KEYS = [
    "src", "timestamp", "ver", "signature", "from", "source",
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
]

# ---- fixed values: image labels ----------------------------------------------
INTERIOR_LABELS = [
    "interior_room", "library", "restaurant", "classroom", "interior_shop",
    "bookshelf", "furniture", "table", "chair", "chair_other", "desk",
]
PEOPLE_LABELS = ["people", "adult", "child", "crowd"]
FACILITY_LABELS = [
    "bookshelf", "furniture", "table", "chair", "chair_other", "desk", "cabinet", "computer",
    "consumer_electronics", "machine", "television", "door", "stairs", "counter", "display_case", "armchair", "stool",
]
EXTERIOR_LABELS = [
    "outdoor", "building", "storefront", "architecture", "house", "apartment",
    "sky", "blue_sky", "street", "road", "sidewalk", "facade",
]
FOOD_LABELS = ["food", "bowl", "plate", "tableware", "utensil", "soup", "meal"]
SEATING_LABELS = ["table", "chair", "chair_other", "desk", "restaurant", "classroom"]
SHELF_LABELS = ["bookshelf", "book", "library"]
WATERMARK_WORDS = (
    r"(?i)大众点评|点评|小红书|水印|抖音|视频号|微博|微信|公众号|搜狐|网易|腾讯|百度|"
    r"新民|上观|新闻晨报|东方网|上海发布|付费专|livespa|@|©|copyright|photo\s*by|摄[影图]|图[片源]"
)
DATE_STAMP = r"(?:\d{2,4})[./年-]\d{1,2}[./月-]\d{1,2}"

# ---- fixed values: description clauses -----------------------------------------
# facility -> list of (pattern, clause); the first matching pattern of a facility wins
FACILITY_CLAUSES = [
    [("无热水|没有热水|不提供热水", "不提供热水"), ("热水|开水", "提供热水"), ("饮水机|饮水处|提供饮水|茶水", "提供饮水")],
    [("无厕所|没有厕所|不设厕所|不提供卫生间", "不设厕所"),
     ("(?:厕所|卫生间|洗手间).{0,10}(?:干净|整洁|无异味)|(?:干净|整洁|无异味).{0,10}(?:厕所|卫生间|洗手间)", "厕所整洁"),
     ("厕所|卫生间|洗手间|蹲厕|坐厕|马桶", "设有厕所")],
    [("无插座|没有插座|不提供插座", "不提供电源插座"), ("插座少|插座有限|少量插座|部分.{0,6}插座", "电源插座数量有限"),
     ("插座|电源|充电口", "设有电源插座")],
    [(r"(?i)无\s*(?:wifi|wi-fi)|没有\s*(?:wifi|wi-fi)|不提供\s*(?:wifi|wi-fi)", "不提供 Wi-Fi"),
     ("(?i)wifi|wi-fi|无线网络", "提供 Wi-Fi")],
    [("很安静|比较安静|环境安静|安静.{0,5}(?:学习|看书|阅读|自习)", "环境安静"), ("嘈杂|吵闹|很吵", "环境较嘈杂")],
    [("宽敞|空间大|面积很大", "空间宽敞"), ("空间小|面积小|地方小|不大", "空间较小")],
    [("采光好|采光充足|光线明亮|明亮", "采光明亮")],
    [("座位多|座位充足|座位够用", "座位较充足"), ("座位少|座位有限|座位紧张", "座位有限")],
    [("环境整洁|环境干净|用餐区.{0,6}(?:整洁|干净)|干净整洁", "环境整洁"), ("舒适|舒服", "环境舒适")],
    [("拥挤|人很多|人多.{0,5}(?:座位|排队)", "高峰时段可能拥挤")],
]
USEFUL_CLAUSE = (
    "入口|步道|跑道|绿道|栈道|园路|草坪|树林|林下|森林|湿地|湖|河|水岸|滨水|亲水|沙滩|码头|观景|平台|花园|花坛|花廊|花架|"
    "亭|廊|桥|广场|座椅|公厕|厕所|停车|无障碍|儿童|滑梯|游乐|健身|篮球|足球|网球|门球|骑行|露营|驿站|茶室|剧场|展馆|温室|"
    "植物园|动物园|雕塑|遗址|墓|纪念馆"
)
FILLER_CLAUSE = (
    "蒸蒸日上|流连忘返|心旷神怡|景色宜人|环境优美|好去处|充分体现|完美融合|美好生活|独具匠心|提供一处|提供了一个|满足.*需求|"
    "打造.*地标|彰显|营造.*氛围|可按该地址导航|属于面向公众|适合|网红|打卡|设计理念|设计思想|设计创意|品质内涵|目标定位|投资|"
    "施工|荣誉称号|游客量|开工|竣工|建成|改造完成|正式开放|故.*命名|以.*为主题|以.*为目的|生态功能"
)
CURATED_TRAILING = r"[。！？；;，,.!?]$"
CURATED_CHANNEL = "(?i)小红书|大众点评|百度|高德|腾讯地图|微博|谷歌|Google"
CURATED_GENERIC = "想读书|想学习|想自习|想阅读|适合读书|适合学习|适合自习|适合阅读"

# ---- fixed values: note eligibility --------------------------------------------
NOTE_TITLE = {
    "图书馆": ("图书馆", "书店|城市书房|流动图书|图书室|借阅点|自习室|大学|学院|学校|校区"),
    "食堂": ("社区.{0,8}食堂|长者食堂|老年食堂|助餐", "自选大食堂|自助大食堂|大学|学院|学校|公司|企业"),
}
NOTE_BODY = {
    "图书馆": ("图书馆", "自习|学习|阅览|阅读|座位|书桌|插座|安静|对外开放|免费开放",
              "流动图书|图书室|借阅点|漂流书|书店|城市书房|付费自习室|校内|内部开放|仅限职工"),
    "食堂": ("社区.{0,10}食堂|长者食堂|老年食堂|助餐点|助餐服务", "",
            "内部食堂|职工食堂|学校食堂|公司食堂|自选大食堂|自助大食堂"),
}
