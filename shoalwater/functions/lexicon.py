"""Word lists and rule rows of the zh-TW catalogue."""

# Every list below must equal the published catalogue for equal results.

SELF_DIRECTED = "我 本人 此號碼 這個號碼 本簡訊 回傳 回覆 回復 私訊 傳給 發給 提供給 客服 專員 上面的連結 下列連結 以下連結".split()
OTHER_DIRECTED = "任何人 他人 別人 外人 第三方 對外".split()
HELP_CHANNELS = "家人 家屬 父母 子女 親友 行員 櫃員 警察 員警 警方 檢察官 店員".split()
IMPERATIVE = "請 麻煩 煩請 務必 速 儘速 盡快 立即 立刻 趕快".split()
SELF_DISCLOSURE = "我是工程師 我在國外 我在杜拜 我在新加坡 我是軍人 我是醫生 駐外 外派 我離婚 我喪偶 我一個人住 我父母過世 我自己創業 我做期貨 我做外匯 我姑姑 我舅舅".split()
EMOTIONAL_COMMITMENT = "想照顧你 照顧你一輩子 當我女朋友 當我男朋友 我們結婚 娶你 嫁給我 視訊給你看 只想跟你 最信任你 把你當家人 我愛你 寶貝 親愛的".split()
CHANNEL_SHIFT = "加我line 加我LINE 加我賴 加我的line 換到這裡聊 私下聊 不要在這個平台 這個平台不方便 留個電話 加телеgram 加我telegram 加我WhatsApp 我們私聊".split()
NEGATION = "不要 不可 不能 不得 不會 不用 不需 無須 毋須 勿 請勿 切勿 嚴禁 禁止 別 莫 絕不 千萬不".split()
ATTRIBUTION = "有人傳給我 有人傳這個 有人傳來 我收到 朋友收到 剛收到 對方說 他說 她說 據說 聽說 網路上流傳 詐騙集團會 歹徒會 對方會".split()
FORWARD_MARKERS = "轉傳 轉發 ※ 以下訊息 幫忙轉發 請大家小心 分享給大家".split()
AWARENESS_FRAME = "千萬不要相信 千萬別相信 這是詐騙 是詐騙集團 請勿受騙 切勿上當 165 反詐騙 提醒大家 警方呼籲 近期常見 新型態詐騙 本行絕不會 絕不會要求".split()

#: One row per rule; words are separated by spaces, $NAME stands for a list above.
RULES = [
    {
        "name": "solicit_otp", "types": "ACCOUNT_TAKEOVER", "hard": True, "negative": False,
        "summary": "索取簡訊驗證碼", "fact": "一次性密碼的定義就是不得轉交，任何機構都不會向本人索取它",
        "predicates": "告訴 告知 提供 傳 回覆 回傳 輸入 給 念 唸 報",
        "objects": "驗證碼 認證碼 簡訊碼 動態密碼 一次性密碼 OTP otp 驗證簡訊 授權碼",
        "receivers": "$SELF_DIRECTED",
    },
    {
        "name": "solicit_card_secret", "types": "PHISHING_LINK FAKE_AUTHORITY", "hard": True, "negative": False,
        "summary": "索取信用卡號、有效期限或背面末三碼", "fact": "金融機構不會以訊息或來電索取卡片背面末三碼",
        "predicates": "告訴 告知 提供 傳 輸入 填 回覆 給 報",
        "objects": "卡號 信用卡號 有效期限 末三碼 背面三碼 安全碼 CVV cvv CVC",
        "receivers": "$SELF_DIRECTED",
    },
    {
        "name": "solicit_bank_credentials", "types": "BANK_ACCOUNT_HARVEST", "hard": True, "negative": False,
        "summary": "索取網路銀行帳號密碼或約定轉帳設定", "fact": "金融機構不會索取網路銀行密碼，也不會請客戶代為設定約定轉帳",
        "predicates": "告訴 告知 提供 傳 輸入 填 回覆 給 設定 開通",
        "objects": "網銀密碼 網路銀行密碼 網銀帳號 帳號密碼 使用者代號 用戶代號 約定轉帳 約定帳號 提款卡密碼 金融卡密碼",
        "receivers": "$SELF_DIRECTED",
    },
    {
        "name": "deliver_bank_instrument", "types": "BANK_ACCOUNT_HARVEST", "hard": True, "negative": False,
        "summary": "要求寄送存摺、印章或提款卡", "fact": "金融機構不收寄存摺與提款卡，交付它們等同交出帳戶控制權",
        "predicates": "寄 寄送 郵寄 宅配 交付 交給 送到 面交 提供",
        "objects": "存摺 印章 提款卡 金融卡 晶片卡 存摺封面 銀行卡",
        "receivers": "$SELF_DIRECTED",
    },
    {
        "name": "atm_operation", "types": "INSTALLMENT_CANCEL ORDER_ANOMALY", "hard": True, "negative": False,
        "summary": "要求至提款機依指示操作或解除設定", "fact": "提款機沒有解除分期付款或更正訂單設定的功能，它只能匯出款項",
        "predicates": "至 到 去 前往 操作 按 輸入 依指示 依照指示 使用",
        "objects": "解除 取消 更正 校正 認證 升級 分期 設定 扣款",
        "receivers": "ATM atm 提款機 自動櫃員機 櫃員機",
    },
    {
        "name": "safe_account", "types": "FAKE_AUTHORITY", "hard": True, "negative": False,
        "summary": "要求把款項匯入監管、安全或公證帳戶", "fact": "我國法制不存在監管帳戶或安全帳戶，檢警不會要求民眾把錢匯到任何帳戶",
        "predicates": "匯 匯入 匯到 匯款 轉帳 轉入 存入 存到 繳交",
        "receivers": "監管帳戶 安全帳戶 公證帳戶 保管帳戶 專案帳戶 監管賬戶 安全賬戶 檢警帳戶",
    },
    {
        "name": "secrecy_demand", "types": "FAKE_AUTHORITY", "hard": True, "negative": True,
        "summary": "要求不得告知家人、行員或警察", "fact": "司法機關不會要求當事人對家人、行員或警察保密，偵查不公開拘束的是承辦人員",
        "predicates": "告訴 告知 說 講 透露 提起 通知 報警 求證",
        "receivers": "$HELP_CHANNELS",
    },
    {
        "name": "remote_control_tool", "types": "FAKE_AUTHORITY FAKE_LOAN", "hard": True, "negative": False,
        "summary": "要求安裝遠端控制軟體", "fact": "金融機構與司法機關不以遠端控制軟體處理業務，安裝後對方可直接操作你的手機",
        "predicates": "安裝 下載 開啟 執行 點選 加入 設定",
        "receivers": "AnyDesk anydesk ANYDESK TeamViewer teamviewer RustDesk AirDroid 快速支援 遠端協助 遠端控制 向日葵",
    },
    {
        "name": "prepay_to_receive", "types": "FAKE_PRIZE FAKE_LOAN FAKE_INVESTMENT FAKE_JOB", "hard": True, "negative": False,
        "summary": "為了領取一筆錢而要求先付出一筆錢", "fact": "領取一筆錢不需要先匯出一筆錢，合法的費用一律自應付金額中扣除",
        "predicates": "繳 匯 付 支付 轉帳 儲值 先繳 先匯 先付",
        "objects": "手續費 保證金 稅金 稅款 工本費 解凍金 認證金 開通費 服務費 履約金 保險金",
        "receivers": "$SELF_DIRECTED 指定帳戶 以下帳戶 下列帳戶 此帳戶 指定帳號 以下帳號",
        "context": "領取 領獎 出金 撥款 退款 解凍 提領 放款 中獎 獎金",
    },
    {
        "name": "seller_verification", "types": "FAKE_BUYER", "hard": True, "negative": False,
        "summary": "要求賣家至連結完成認證或開通商店", "fact": "拍賣平台不存在需由買家提供連結才能完成的賣家認證或開通商店流程",
        "predicates": "完成 進行 辦理 點選 申請 認證 開通 設定",
        "objects": "賣家認證 賣場認證 商店認證 開通商店 賣家資格 面交認證 分期開通",
        "receivers": "連結 網址 客服 專員 下列 以下 我",
    },
    {
        "name": "guaranteed_return", "types": "FAKE_INVESTMENT", "hard": False, "negative": False,
        "summary": "宣稱保證獲利或零風險", "fact": "",
        "predicates": "保證獲利 保證收益 保證賺 穩賺不賠 穩賺 零風險 無風險 包賺 必賺 穩定獲利 保本保息 日結獲利 獲利翻倍 穩定配息",
    },
    {
        "name": "romance_pretext", "types": "ROMANCE_MARRIAGE", "hard": False, "negative": False,
        "summary": "以清關費、機票或醫療費為由要錢，並承諾來台或結婚", "fact": "",
        "predicates": "需要 支付 匯 繳 寄 幫我 借我 先幫",
        "objects": "清關費 關稅 機票 機票錢 醫療費 簽證費 包裹卡關 手續費",
        "context": "結婚 來台 見面 一起生活 未婚妻 老婆 娶 嫁 團聚 退休",
    },
    {
        "name": "identity_docs", "types": "FAKE_JOB FAKE_LOAN BANK_ACCOUNT_HARVEST", "hard": False, "negative": False,
        "summary": "索取身分證、健保卡或存摺封面照片", "fact": "",
        "predicates": "提供 傳 上傳 拍 寄 給 傳送 附上",
        "objects": "身分證正反面 身分證照片 身分證 健保卡 駕照 存摺封面 證件照 雙證件",
    },
    {
        "name": "escort_deposit", "types": "SEXUAL_SERVICE", "hard": False, "negative": False,
        "summary": "要求先儲值或先付訂金才派人", "fact": "",
        "predicates": "儲值 加值 先付 先匯 匯 付 刷卡 轉帳",
        "objects": "誠意金 訂金 定金 保證金 車馬費 點數 儲值金",
        "context": "外約 全套 半套 出鐘 應召 茶莊 指壓 上門服務 妹妹",
    },
    {
        "name": "game_code", "types": "GAME_ITEM", "hard": False, "negative": False,
        "summary": "索取點數卡序號或指定代儲、代管站", "fact": "",
        "predicates": "提供 傳 給 輸入 購買 代儲 拍 儲值",
        "objects": "點數卡 點數序號 遊戲點數 序號 虛寶 寶物 代儲 代管站 MyCard 遊戲幣",
    },
    {
        "name": "identity_reset", "types": "GUESS_WHO", "hard": False, "negative": False,
        "summary": "宣稱換了號碼或帳號並要對方猜身分", "fact": "",
        "predicates": "猜猜我是誰 猜我是誰 你猜我是誰 換號碼了 換了新號碼 換新手機了 我的新帳號 我的新號碼 這是我的新",
    },
    {
        "name": "charity_personal_account", "types": "FAKE_CHARITY", "hard": False, "negative": False,
        "summary": "具名募款並指定帳戶與期限", "fact": "",
        "predicates": "捐款 捐助 贊助 匯款 轉帳 匯 小額捐",
        "objects": "急難救助 醫療費 罹癌 救助金 善款 重病 孤兒院 流浪動物",
        "receivers": "帳戶 帳號 戶名 指定帳戶 郵局帳號",
        "context": "今天 今日 最後 截止 期限 只剩 急需 明天前 限時",
    },
    {
        "name": "parcel_notice", "types": "FAKE_PARCEL", "hard": False, "negative": False,
        "summary": "冒稱物流通知並要求更新地址或補繳費用", "fact": "",
        "predicates": "更新 填寫 補繳 繳納 確認 點選 重新 補填",
        "objects": "地址 關稅 運費 收件資訊 派送 清關 收件地址 郵資",
        "context": "包裹 郵局 快遞 貨件 物流 宅配 郵政 配送",
    },
    {
        "name": "loan_no_check", "types": "FAKE_LOAN", "hard": False, "negative": False,
        "summary": "宣稱免聯徵、免對保或線上快速核貸", "fact": "",
        "predicates": "免聯徵 免對保 免抵押 免留車 不看信用 信用瑕疵可辦 黑戶可辦 快速核貸 當日撥款 秒過件 免照會",
    },
    {
        "name": "high_pay_no_skill", "types": "FAKE_JOB", "hard": False, "negative": False,
        "summary": "宣稱高薪日結、免經驗、在家可做", "fact": "",
        "predicates": "日領 日結 高薪 免經驗 無經驗 輕鬆賺 在家工作 動動手指 時間自由",
        "context": "徵 招募 兼職 打工 工作 職缺 應徵 求職 人手",
    },
]
