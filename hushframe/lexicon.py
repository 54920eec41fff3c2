"""Fixed values of the detectors: word lists, character classes and patterns of fields.

These state what counts as an identifier in (mostly Chinese) clinical text; results
depend on them letter by letter.  Patterns are written for Java regular expressions.
"""

# Characters without a glyph of their own, removed before detection.
INVISIBLE = (
    "\\x{00ad}\\x{061c}\\x{180e}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{2064}\\x{2066}-\\x{206f}"
    "\\x{fe00}-\\x{fe0f}\\x{feff}\\x{fff9}-\\x{fffb}\\x{1d173}-\\x{1d17a}\\x{e0000}-\\x{e007f}\\x{e0100}-\\x{e01ef}"
)

# Surnames, given-name characters, name marks.
SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾"
    "肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏"
    "韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴"
    "莫孔向汤常温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿"
    "关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季裴霍涂成苗谷盛曲翁冉"
)
GIVEN = (
    "某伟芳娜敏静磊军洋勇艳杰娟涛明超秀兰桂英玉梅建国淑"
    "芬海燕文博思远雅丽华强平刚毅鹏辉宇轩晨阳雪松柏青"
    "志晓小红春秋菊冬珍爱民生新庆永花凤金银香竹林树大"
    "武立学峰龙江山河彩霞云东亚楠男琴君嘉佳怡慧俊天佑"
    "德波瑞"
    "婷妍婉珊媛娅姗姝婧婕妤茜蕾薇蓉菲芸芊蕊沁瑶琪琳璐瑾瑜瑄玥彤悦莹颖倩晴"
    "浩睿宸昊泽霖铭煜烨熙辰皓弘骏靖翊峻崇琛珩珏璋琦珂珺鑫曦涵爽钧锐锦凯"
)
COMPOUND_SURNAMES = (
    "欧阳|司马|上官|诸葛|东方|独孤|南宫|西门|夏侯|皇甫|尉迟|公孙|"
    "慕容|司徒|令狐|宇文|长孙|轩辕|赫连|澹台|公冶|宗政|濮阳|淳于|"
    "太叔|申屠|仲孙|钟离|鲜于|闾丘|司空|端木|巫马|公西|漆雕|乐正|"
    "拓跋|百里|东郭|南门|呼延|羊舌|微生|梁丘|左丘|第五"
)
NAME_MARKS = "\\x{3400}-\\x{9fff}\\x{00b7}\\x{30fb}\\x{2027}"
# Words that may follow a name directly.
AFTER_NAME = (
    "入院|出院|就诊|住院|治疗|复查|随访|主诉|既往|收入|收住|收治|转入|转科|"
    "查房|病情|陪同|签字|执行|查看|测量|交接|表示|同意|拒绝|要求|建议|"
    "否认|"
    "自述|护理|看护|照料|负责|操作|实施|完成|给予|服用|注射|检查|化验|"
    "告知|交代|说明|询问|签署|确认|办理|准备|安排|护送|转运|接收|进入|"
    "离开|返回|因|于|诉|在|自|伴|拟|系|之|由|以|"
    "电话|手机|邮箱|身份证|证件|病历号|住院号|就诊号|地址|住址|诊断|"
    "症状|用药|医生|医师|大夫|护士|护师|"
    "教授|副教授|讲师|助教|院士|博导|研究员|副研究员|"
    "博士|硕士|学士|专家|技师|主管技师|药师|主管药师|检验师|"
    "护士长|院长|副院长|主任|副主任|科主任|主任医师|副主任医师"
)

# Field labels and titles.
PATIENT_LABELS = "患者姓名|病人姓名|患者名字|患者|病人|姓名|名字"
PATIENT_NEXT_FIELDS = "电话|手机|邮箱|身份证号?|证件号?|病历号|住院号|就诊号|地址|住址|诊断|症状|用药|治疗"
RECORD_LABELS = "病历号码|住院号码|病历号|住院号|入院号|登记号|就诊号|门诊号|病案号|档案号|患者编号|病人编号"
ADDRESS_LABELS = "家庭住址|联系地址|现住址|户籍所在地|户籍地|籍贯|工作单位|单位地址|住址|地址"
ADDRESS_VERBS = "现住|居住于|居住在|住在|家住|户籍在|户籍地|籍贯|住(?!院|所|房)"
ADDRESS_ENDS = "省|市|区|县|旗|镇|乡|街道|路|街|巷|号|室|栋|楼|单元|村|组|社区"
SPECIMEN_LABELS = "标本号|标本编号|样本号|样本编号"
ACCESSION_LABELS = "检查号|影像号|申请号|检查编号|影像编号|报告编号"
POSTAL_LABELS = r"邮政编码|邮编|postal\s*code"
SOCIAL_LABELS = "微信号|微信|QQ号|QQ|企鹅号"
BED_LABELS = "床号|床位号"
DOCTOR_TITLES = (
    "主任医师|副主任医师|主治医师|住院医师|主管医师|经治医师|"
    "接诊医师|手术医师|会诊医师|主刀医生|管床医生|手术医生|"
    "接诊医生|经治医生|值班医生|"
    "医师签名|医生签名|签名|一助|二助|手术助手|助手|"
    "医生|医师|大夫"
)
NURSE_TITLES = "责任护士|值班护士|接诊护士|主管护师|护士长|护士|护师"
RELATIVES = "其妻|其夫|其子|其女|其父|其母|其兄|其弟|父亲|母亲|儿子|女儿|丈夫|妻子|配偶|家属|哥哥|姐姐|弟弟|妹妹|祖父|祖母|外祖父|外祖母"
RARE_CASES = "本例|该例|此例|本患者|该患者|此患者|本病例|该病例|患者|患儿|病人"
POPULATION_LEAD = "多见于|多发于|好发于|高发于|见于|纳入|选取|年龄在|超过|大于|小于|至少|多为|大于等于|小于等于|一般在"

# How ages and sexes are written, what stands before and behind them, and what makes an age one of a group.
AGE_UNITS = ("岁", "周岁")
AGE_GROUP_ENDS = ("以上", "以下", "左右", "上下", "及以上", "及以下")
AGE_ERA_ENDS = ("年代", "时期")
AGE_LESS_THAN = "不足"
MONTH_UNITS = ("月", "个月")
MONTH_ENDS = ("龄", "大")
MONTH_SUBJECTS = ("患儿", "出生后", "婴儿", "幼儿")
MONTH_LABELS = ("年龄", "月龄")
SEXES = ("男", "女")
SEX_LABEL = "性别"
SEX_SUBJECTS = ("患者", "病人", "患儿", "伤者")
SEX_SUFFIX = "性"
SEX_NOUNS = ("患者", "病人", "病例", "住院", "就诊", "体检", "受检")
DOCTOR_SHORT_TITLES = ("医生", "医师", "大夫")
NURSE_SHORT_TITLES = ("护士",)
# Characters before a short title that make it part of a longer one.
DOCTOR_TITLE_STARTS = ("主", "责")
NURSE_TITLE_STARTS = ("责", "主")

# Institutions.
DEPARTMENTS = (
    "神经内科",
    "神经外科",
    "心内科",
    "心血管内科",
    "呼吸内科",
    "消化内科",
    "内分泌科",
    "肾内科",
    "血液科",
    "风湿免疫科",
    "感染科",
    "肿瘤科",
    "普通外科",
    "普外科",
    "骨科",
    "创伤骨科",
    "脊柱外科",
    "泌尿外科",
    "胸外科",
    "心脏外科",
    "肝胆外科",
    "血管外科",
    "肛肠科",
    "妇产科",
    "妇科",
    "产科",
    "儿科",
    "新生儿科",
    "眼科",
    "耳鼻咽喉科",
    "口腔科",
    "皮肤科",
    "精神科",
    "心理科",
    "康复科",
    "中医科",
    "针灸科",
    "急诊科",
    "重症医学科",
    "麻醉科",
    "疼痛科",
    "影像科",
    "放射科",
    "超声科",
    "检验科",
    "病理科",
    "输血科",
    "营养科",
    "药剂科",
    "门诊部",
    "住院部",
    "手术室",
    "导管室",
    "内镜中心",
    "血液净化中心",
)
DEPARTMENT_LABELS = "科室|部门|病区|病房"
DEPARTMENT_MOVES = "转入|转至|转往|收入|收治|入住|收住"
DEPARTMENT_NEXT = "门诊|病房|病区|住院|转入|转出|转至|转往"
HOSPITAL_ENDS = (
    "附属医院", "医疗中心", "医学中心", "卫生院", "医科大学", "医学院", "医院",
)
HOSPITAL_VERBS = (
    "建议转诊至", "建议转诊", "建议转往", "建议转入", "建议转", "就诊于", "转诊至", "转诊到", "转往", "转入", "转出", "送往", "送至", "前往", "赴", "就诊", "转诊", "于", "至", "在", "到", "转", "送",
)
HOSPITAL_GENERIC = (
    "三级甲等",
    "三级乙等",
    "三甲",
    "三乙",
    "二甲",
    "二乙",
    "三级",
    "二级",
    "一级",
    "甲等",
    "乙等",
    "上级",
    "下级",
    "当地",
    "本地",
    "外地",
    "外院",
    "该院",
    "本院",
    "我院",
    "贵院",
    "综合",
    "专科",
    "社区",
    "基层",
    "定点",
    "公立",
    "民营",
    "中心",
    "有关",
    "相关",
    "各级",
    "各类",
    "其他",
    "同一",
)
HOSPITAL_CUT = "为是在的于到至往转送等其并就而则"
WARD_GENERIC = (
    "各科", "全科", "所有", "部分", "其他", "上述", "同一", "本", "该", "各", "全", "此", "每",
)
REFERRAL = "建议|转诊至|转至|转往|请|至|到"

# Medical words; GB 11643 weights and check characters.
MEDICAL = (
    "诊断|疾病|病史|症状|检验|检查结果|用药|药物|治疗|手术|过敏史|"
    "入院|出院|住院|主诉|既往|病程|会诊|转科|急诊|服药|"
    r"diagnosis|disease|medication|treatment|laboratory|lab\s+result|"
    r"HIV|AIDS|Crohn(?:'s)?\s+disease"
)
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECK = "10X98765432"
NUMERALS = "零一二三四五六七八九"

# Field names of records and the label that each stands for.
FIELD_LABELS = {
    "name": "姓名", "patientname": "患者姓名", "patient": "患者", "phone": "电话", "tel": "电话", "telephone": "电话", "mobile": "手机", "phonenumber": "电话", "email": "邮箱",
    "idcard": "身份证号", "idnumber": "身份证号", "nationalid": "身份证号", "governmentid": "身份证号", "mrn": "病历号", "medicalrecordnumber": "病历号", "recordnumber": "病历号",
    "address": "住址", "homeaddress": "住址", "postalcode": "邮编", "zipcode": "邮编", "wechat": "微信", "qq": "QQ号", "birthdate": "出生日期", "dateofbirth": "出生日期", "dob": "出生日期",
    "date": "日期", "age": "年龄", "sex": "性别", "gender": "性别", "department": "科室", "ward": "病区", "bed": "床号", "bednumber": "床号", "institution": "机构", "hospital": "医院",
    "doctor": "医生", "physician": "医师", "nurse": "护士",
    "姓名": "姓名", "患者姓名": "患者姓名", "患者": "患者", "电话": "电话", "手机": "手机", "邮箱": "邮箱", "身份证号": "身份证号", "身份证": "身份证号", "病历号": "病历号", "住院号": "住院号",
    "住址": "住址", "地址": "住址", "邮编": "邮编", "微信": "微信", "出生日期": "出生日期", "年龄": "年龄", "性别": "性别", "科室": "科室", "病区": "病区", "床号": "床号", "医院": "医院",
    "医生": "医生", "医师": "医师", "护士": "护士",
    "family": "姓名", "given": "姓名", "surname": "姓名", "prefix": "姓名", "fullname": "姓名", "identifier": "病历号", "telecom": "电话", "deceaseddatetime": "日期", "onsetdatetime": "日期",
    "effectivedatetime": "日期", "recordeddate": "日期", "authoredon": "日期", "period": "日期", "servicecode": "科室",
}

# FHIR resources that are read, and the parts of a name in order.
FHIR_RESOURCES = (
    "Patient", "Observation", "DiagnosticReport", "Condition", "MedicationRequest", "Encounter", "ImagingStudy", "Bundle",
)
FHIR_NAME_PARTS = (
    "family", "given", "middle", "prefix", "suffix",
)
FHIR_WHOLE_NAMES = (
    "text", "fullname", "name",
)
