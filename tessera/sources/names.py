"""Names and cities by locale, as plain text.

Fixed values, from public statistics. Given names: the most frequent of births or residents as national offices publish
them (SSA 2021, ONS 2021, INE residents, INSEE 2021), for Urdu, Arabic, Hindi and Chinese widespread names of public name
lists; all in alphabetical order of the Latin form. Surnames: census, electoral or registry frequency, in alphabetical
order. Cities: the largest by census, in order of population. Where a script is not Latin, a line is "native Latin"
pairs parted by commas.
"""

from __future__ import annotations

TEXT = {
    "en-US": {
        "f": "Abigail, Amelia, Ava, Camila, Charlotte, Elizabeth, Ella, Emily, Emma, Evelyn, Gianna, Harper, Isabella, Luna, Mia, Mila, Olivia, Scarlett, Sofia, Sophia",
        "m": "Alexander, Benjamin, Daniel, Elijah, Ethan, Henry, Jack, Jackson, Jacob, James, Levi, Liam, Logan, Lucas, Mason, Mateo, Michael, Noah, Oliver, William",
        "last": "Anderson, Brown, Clark, Davis, Garcia, Gonzalez, Harris, Hernandez, Jackson, Johnson, Jones, Lee, Lopez, Martin, Martinez, Miller, Moore, Perez, Rodriguez, Smith, Taylor, Thomas, Thompson, White, Williams, Wilson",
        "cities": "New York, Los Angeles, Chicago, Houston, Phoenix, Philadelphia, San Antonio, San Diego, Dallas, San Jose, Austin, Jacksonville, Fort Worth, Columbus, Indianapolis, Charlotte, San Francisco, Seattle, Denver, Washington, Nashville, Oklahoma City, El Paso, Boston",
    },
    "en-GB": {
        "f": "Amelia, Ava, Daisy, Elsie, Emily, Evie, Florence, Freya, Grace, Isabella, Isla, Ivy, Lily, Mia, Olivia, Phoebe, Rosie, Sienna, Sophia, Willow",
        "m": "Alfie, Archie, Arthur, Charlie, Finley, Freddie, George, Harry, Henry, Jack, Jude, Leo, Luca, Muhammad, Noah, Oliver, Oscar, Theo, Theodore, Thomas",
        "last": "Brown, Clarke, Davies, Edwards, Evans, Green, Hall, Hughes, Jackson, Johnson, Jones, Lewis, Patel, Roberts, Robinson, Smith, Taylor, Thomas, Thompson, Walker, White, Williams, Wilson, Wood, Wright",
        "cities": "London, Birmingham, Leeds, Glasgow, Sheffield, Manchester, Edinburgh, Liverpool, Bristol, Cardiff, Leicester, Wakefield, Coventry, Nottingham, Newcastle, Sunderland, Belfast, Plymouth, Wolverhampton, Derby",
    },
    "es-ES": {
        "f": "Ana, Ana Isabel, Ana María, Antonia, Carmen, Cristina, Dolores, Francisca, Isabel, Josefa, Laura, Lucía, María, María Carmen, María Dolores, María José, María Pilar, María Teresa, Marta, Pilar",
        "m": "Alejandro, Antonio, Carlos, Daniel, David, Francisco, Francisco Javier, Javier, Jesús, José, José Antonio, José Luis, Juan, Juan José, Luis, Manuel, Miguel, Miguel Ángel, Pedro, Rafael",
        "last": "Alonso, Álvarez, Díaz, Domínguez, Fernández, García, Gil, Gómez, González, Gutiérrez, Hernández, Jiménez, López, Martín, Martínez, Moreno, Muñoz, Navarro, Pérez, Ramos, Rodríguez, Romero, Ruiz, Sánchez, Torres, Vázquez",
        "cities": "Madrid, Barcelona, Valencia, Sevilla, Zaragoza, Málaga, Murcia, Palma, Las Palmas, Bilbao, Alicante, Córdoba, Valladolid, Vigo, Gijón, Vitoria, La Coruña, Granada, Elche, Oviedo",
    },
    "fr-FR": {
        "f": "Agathe, Alba, Alice, Alma, Ambre, Anna, Chloé, Emma, Inès, Iris, Jade, Julia, Léa, Léna, Lou, Louise, Mila, Rose, Romane, Zoé",
        "m": "Adam, Arthur, Eden, Ethan, Gabriel, Hugo, Isaac, Jules, Léo, Liam, Louis, Lucas, Maël, Marius, Nathan, Noah, Noé, Paul, Raphaël, Sacha",
        "last": "André, Bernard, Bertrand, Bonnet, David, Dubois, Durand, Fournier, Garcia, Girard, Lambert, Laurent, Lefebvre, Leroy, Martin, Mercier, Michel, Moreau, Morel, Petit, Richard, Robert, Roux, Simon, Thomas, Vincent",
        "cities": "Paris, Marseille, Lyon, Toulouse, Nice, Nantes, Montpellier, Strasbourg, Bordeaux, Lille, Rennes, Toulon, Reims, Saint-Étienne, Le Havre, Dijon, Grenoble, Angers, Villeurbanne, Nîmes",
    },
    "ur-PK": {
        "f": "عالیہ Alia, امینہ Amina, انعم Anam, عاصمہ Asma, بشریٰ Bushra, فائزہ Faiza, فرح Farah, حفصہ Hafsa, حنا Hina, ہما Huma, کنزہ Kinza, لبنیٰ Lubna, ماہین Maheen, مریم Maryam, نادیہ Nadia, نبیلہ Nabila, رابعہ Rabia, ثنا Sana, شازیہ Shazia, صدف Sadaf, سمیرا Sumaira, ثمینہ Samina, عظمیٰ Uzma, زارا Zara",
        "m": "عادل Adil, عامر Amir, ارسلان Arsalan, اسد Asad, بلال Bilal, دانش Danish, فہد Fahad, فیصل Faisal, فرحان Farhan, حمزہ Hamza, حسن Hassan, عمران Imran, جنید Junaid, کامران Kamran, خرم Khurram, نعمان Nauman, نوید Naveed, عمیر Umair, عثمان Usman, راشد Rashid, سلمان Salman, شاہد Shahid, طارق Tariq, زاہد Zahid",
        "last": "عباسی Abbasi, انصاری Ansari, اعوان Awan, باجوہ Bajwa, بلوچ Baloch, بٹ Butt, چیمہ Cheema, ڈار Dar, درانی Durrani, گیلانی Gilani, جنجوعہ Janjua, کاظمی Kazmi, کھوکھر Khokhar, لغاری Leghari, مغل Mughal, نیازی Niazi, پراچہ Paracha, قریشی Qureshi, رانا Rana, سید Syed, صدیقی Siddiqui, یوسفزئی Yousafzai, زیدی Zaidi",
        "cities": "کراچی, لاہور, فیصل آباد, راولپنڈی, گوجرانوالہ, ملتان, حیدر آباد, پشاور, اسلام آباد, کوئٹہ, سرگودھا, سیالکوٹ, بہاولپور, سکھر, جھنگ, شیخوپورہ, لاڑکانہ, گجرات, مردان, قصور",
    },
    "ar-AE": {
        "f": "عائشة Aisha, علياء Alia, أمل Amal, أسماء Asma, بدرية Badria, فرح Farah, غالية Ghalia, هدى Huda, هند Hind, خولة Khawla, لطيفة Latifa, ليلى Layla, منى Mona, موزة Mouza, نوال Nawal, روضة Rawda, ريم Reem, سلامة Salama, سارة Sara, شمسة Shamsa, شيخة Sheikha, زينب Zainab",
        "m": "عبدالله Abdullah, أحمد Ahmed, علي Ali, بدر Badr, فهد Fahd, فيصل Faisal, حمد Hamad, حمدان Hamdan, حسن Hassan, إبراهيم Ibrahim, جاسم Jassim, ماجد Majid, منصور Mansour, محمد Mohammed, مبارك Mubarak, ناصر Nasser, راشد Rashid, سعيد Saeed, سالم Salem, سلطان Sultan, طارق Tariq, زايد Zayed",
        "last": "العامري Al Ameri, البلوشي Al Balushi, الظاهري Al Dhaheri, الفلاسي Al Falasi, الحمادي Al Hammadi, الحوسني Al Hosani, الجابري Al Jaberi, الكعبي Al Kaabi, الكتبي Al Ketbi, المهيري Al Muhairi, المري Al Marri, المزروعي Al Mazrouei, النقبي Al Naqbi, القبيسي Al Qubaisi, الرميثي Al Romaithi, الشامسي Al Shamsi, السويدي Al Suwaidi, الطنيجي Al Tunaiji, الزعابي Al Zaabi",
        "cities": "دبي, أبوظبي, الشارقة, العين, عجمان, رأس الخيمة, الفجيرة, أم القيوين, خورفكان, كلباء, جبل علي, دبا الفجيرة, مدينة زايد, الرويس, الذيد",
    },
    "hi-IN": {
        "f": "अदिति Aditi, अंजलि Anjali, अर्चना Archana, भावना Bhavna, दीपा Deepa, दिव्या Divya, गीता Geeta, ज्योति Jyoti, कविता Kavita, किरण Kiran, लता Lata, मीना Meena, नेहा Neha, निशा Nisha, पूजा Pooja, राधा Radha, रेखा Rekha, ऋतु Ritu, संगीता Sangeeta, सीमा Seema, शालिनी Shalini, स्वाति Swati, उषा Usha, विद्या Vidya",
        "m": "अजय Ajay, अनिल Anil, अर्जुन Arjun, अशोक Ashok, भरत Bharat, दीपक Deepak, गौरव Gaurav, गोपाल Gopal, हरीश Harish, जितेंद्र Jitendra, करण Karan, कृष्ण Krishna, मनोज Manoj, मोहन Mohan, नितिन Nitin, प्रकाश Prakash, राजेश Rajesh, रमेश Ramesh, संजय Sanjay, सुरेश Suresh, उमेश Umesh, विकास Vikas, विनोद Vinod, योगेश Yogesh",
        "last": "अग्रवाल Agarwal, भट्ट Bhatt, चौधरी Chaudhary, चौहान Chauhan, दास Das, देशमुख Deshmukh, दुबे Dubey, गर्ग Garg, जैन Jain, जोशी Joshi, कपूर Kapoor, कुमार Kumar, मेहता Mehta, मिश्रा Mishra, नायर Nair, पाण्डेय Pandey, पटेल Patel, राव Rao, राठौर Rathore, सक्सेना Saxena, सिंह Singh, सोनी Soni, तिवारी Tiwari, यादव Yadav",
        "cities": "मुंबई, दिल्ली, बेंगलुरु, हैदराबाद, अहमदाबाद, चेन्नई, कोलकाता, सूरत, पुणे, जयपुर, लखनऊ, कानपुर, नागपुर, इंदौर, ठाणे, भोपाल, विशाखापत्तनम, पटना, वडोदरा, गाजियाबाद",
    },
    "zh-CN": {
        "f": "爱华 Aihua, 春梅 Chunmei, 丹 Dan, 芳 Fang, 桂英 Guiying, 红 Hong, 慧 Hui, 佳怡 Jiayi, 洁 Jie, 静 Jing, 丽娟 Lijuan, 玲 Ling, 美玲 Meiling, 娜 Na, 倩 Qian, 淑珍 Shuzhen, 婷 Ting, 霞 Xia, 欣怡 Xinyi, 雪 Xue, 雅静 Yajing, 燕 Yan, 颖 Ying, 玉兰 Yulan",
        "m": "斌 Bin, 波 Bo, 超 Chao, 东 Dong, 飞 Fei, 刚 Gang, 国华 Guohua, 海涛 Haitao, 浩 Hao, 辉 Hui, 建国 Jianguo, 建华 Jianhua, 杰 Jie, 俊 Jun, 凯 Kai, 亮 Liang, 明 Ming, 鹏 Peng, 平 Ping, 涛 Tao, 文 Wen, 旭 Xu, 勇 Yong, 宇轩 Yuxuan",
        "last": "陈 Chen, 邓 Deng, 董 Dong, 冯 Feng, 高 Gao, 郭 Guo, 韩 Han, 何 He, 胡 Hu, 黄 Huang, 蒋 Jiang, 李 Li, 梁 Liang, 林 Lin, 刘 Liu, 罗 Luo, 马 Ma, 孙 Sun, 唐 Tang, 王 Wang, 吴 Wu, 徐 Xu, 杨 Yang, 张 Zhang, 赵 Zhao, 郑 Zheng, 周 Zhou, 朱 Zhu",
        "cities": "上海, 北京, 深圳, 重庆, 广州, 成都, 天津, 武汉, 东莞, 西安, 杭州, 佛山, 南京, 沈阳, 青岛, 济南, 长沙, 哈尔滨, 郑州, 昆明",
    },
}


def entries(text: str) -> list[tuple[str, str]]:
    """(native, Latin) of each entry; the same twice in Latin scripts."""
    out = []
    for part in text.split(", "):
        native, _, latin = part.partition(" ")
        out.append((part, part) if part.isascii() or not latin or ord(native[0]) < 0x250 else (native, latin))
    return out


def names(locale: str) -> dict:
    """A pack's ``first``, ``last``, ``cities`` and, where the script is not Latin, ``latin``."""
    found = {k: entries(TEXT[locale][k]) for k in ("f", "m", "last")}
    pack = {"first": {k: [n for n, _ in found[k]] for k in ("f", "m")}, "last": [n for n, _ in found["last"]], "cities": TEXT[locale]["cities"].split(", ")}
    latin = {n: la for part in found.values() for n, la in part if n != la}
    return pack | ({"latin": latin} if latin else {})
