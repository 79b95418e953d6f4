"""Labelled sentences per language, written for this package.

They seed the compression dictionaries of ``langid``.  Each entry is plain
running text: messages of programs and everyday sentences.
"""

TEXT = {
    "en": """
The file could not be found. Please choose another folder and try again. You do not have the right to change this file.
Are you sure that you want to delete the selected items? This cannot be undone. The disk is full, free some space before you go on.
We could not connect to the server because the network is down. Press any key to continue or wait a few seconds.
Your changes have been saved. There is nothing to see here yet, come back later when it is ready. The password must have at least eight letters.
Another program is still using this window. Close it first, then start again. It may take some minutes until the update has finished.
The old man walked slowly down to the river with his dog. She told us that the house was empty and the door was open. Nobody knew what had happened to them.
Only the first rows of the list are shown. The value is not valid for this field. Somebody has already opened the last backup.
This function must never be called twice by the same thread. The caller owns the memory and has to free it. If the branch is taken, the result is wrong.
Wait for the wind to turn and for the rain to stop. Half of the people are missing from the picture. Could you give me the name of the map and the number of players?
Unable to read the settings without asking the user. The program failed to write its log while the printer was busy. Do not turn off your computer.
Hold the button down to skip the intro. Ask the owner for a new card and sign in once more. Too many attempts for today, come back tomorrow.
It rained all night and the old well was full again, but the road to the north stayed dry. Come back when the weather is better. The gate opens in the morning and closes after dark.
This happens before the light has been added to the picture. We count the letters one after another and then put them into the right order. Three of the stones in the wall are loose.
Log in with your account name and reset it if it does not work. Use the other box until it has been changed. Giving up after several tries. The default is used when nothing else was given.
You must be there before the others. Each user should have a name of their own, or nothing will work. Wait until everything is ready. We had to leave because nobody had stayed in that house. They always walk along the same street with their friends, and so does she.
""",
    "de": """
Die Datei wurde nicht gefunden. Bitte wählen Sie einen anderen Ordner und versuchen Sie es noch einmal. Sie haben nicht das Recht, diese Datei zu ändern.
Möchten Sie die ausgewählten Einträge wirklich löschen? Das kann nicht rückgängig gemacht werden. Die Festplatte ist voll, bitte schaffen Sie zuerst Platz.
Wir konnten keine Verbindung zum Server herstellen, weil das Netz nicht verfügbar ist. Drücken Sie eine Taste, um fortzufahren, oder warten Sie einige Sekunden.
Ihre Änderungen wurden gespeichert. Hier gibt es noch nichts zu sehen, kommen Sie später wieder. Das Passwort muss mindestens acht Zeichen haben.
Ein anderes Programm benutzt dieses Fenster noch. Schließen Sie es zuerst und starten Sie dann neu. Es kann einige Minuten dauern, bis die Aktualisierung fertig ist.
Der alte Mann ging langsam mit seinem Hund zum Fluss hinunter. Sie sagte uns, dass das Haus leer war und die Tür offen stand. Niemand wusste, was mit ihnen geschehen war.
Nur die ersten Zeilen der Liste werden angezeigt. Der Wert ist für dieses Feld nicht gültig. Jemand hat die letzte Sicherung schon geöffnet.
Diese Funktion darf nie zweimal aufgerufen werden. Der Aufrufer muss den Speicher selbst freigeben. Dieser Zweig wird nie erreicht, wenn das Ergebnis falsch ist.
Das Programm konnte die Einstellungen nicht ohne Prüfung lesen. Während der Sicherung ist der Drucker beschäftigt. Schalten Sie das Gerät vor dem Neustart nicht aus.
Halten Sie die Taste gedrückt, um den Vorspann zu überspringen. Zu viele Versuche, heute ist Schluss. Der Wolf schläft, bis ihn jemand weckt. Wir wollten gerade noch einmal fragen.
Es regnete die ganze Nacht, und der alte Brunnen war wieder voll, aber die Straße nach Norden blieb trocken. Kommen Sie wieder, wenn das Wetter besser ist. Das Tor wird am Morgen geöffnet und am Abend geschlossen.
Das geschieht, bevor das Licht zum Bild hinzugefügt wird. Wir zählen die Buchstaben nacheinander und bringen sie dann in die richtige Reihenfolge. Hier wird der Schatten berechnet. Drei Steine in der Mauer sind lose.
Bitte nicht mehr öffnen, solange der Dienst läuft. Man darf die Größe nicht ohne Grund ändern. Das letzte Gerät steht nicht in der Liste.
Sie müssen vor den anderen da sein. Jeder Benutzer soll einen eigenen Namen haben, sonst geht gar nichts. Warten Sie, bis alles fertig ist. Wir mussten gehen, weil niemand in diesem Haus geblieben war. Sie gehen immer mit ihren Freunden durch dieselbe Straße, und sie auch.
""",
    "fr": """
Le fichier est introuvable. Veuillez choisir un autre dossier et réessayer. Vous n'avez pas le droit de modifier ce fichier.
Voulez-vous vraiment supprimer les éléments sélectionnés ? Cette action est définitive. Le disque est plein, libérez d'abord de la place.
Impossible de se connecter au serveur car le réseau n'est pas disponible. Appuyez sur une touche pour continuer ou attendez quelques secondes.
Vos modifications ont été enregistrées. Il n'y a rien à voir ici pour l'instant, revenez plus tard. Le mot de passe doit avoir au moins huit caractères.
Un autre programme utilise encore cette fenêtre. Fermez-la d'abord, puis redémarrez. La mise à jour peut prendre quelques minutes avant le prochain démarrage.
Le vieil homme descendait lentement vers la rivière avec son chien. Elle nous a dit que la maison était vide et que la porte était ouverte. Personne ne savait ce qui leur était arrivé.
Seules les premières lignes de la liste sont affichées. La valeur n'est pas valable pour ce champ. Quelqu'un a déjà ouvert la dernière sauvegarde.
Cette fonction ne doit jamais être appelée deux fois. L'appelant doit libérer lui-même la mémoire. Cette branche n'est jamais prise, si le résultat est faux.
Le programme n'a pas pu lire les réglages sans l'accord du propriétaire. Il faut encore vérifier les données de l'écran pendant la copie. N'éteignez pas l'appareil après cette étape.
Maintenez la touche pour passer l'introduction. Trop d'essais pour aujourd'hui, c'est fini. Le loup dort jusqu'à ce qu'on le réveille. Vous ne pouvez plus changer de compte.
Il a plu toute la nuit et le vieux puits était de nouveau plein, mais la route du nord restait sèche. Revenez quand il fera meilleur. La porte ouvre le matin et ferme le soir.
Cela se passe avant que la lumière soit ajoutée à l'image. On compte les lettres une à une, puis on les met dans le bon ordre. On mélange les couleurs avant de peindre. Trois pierres du mur ne tiennent plus.
Le service ne répond plus, essayez plus tard. Il ne reste que deux pages dans la mémoire. Gardez la clé avec vous.
Il faut que vous soyez là avant les autres. Chaque utilisateur doit avoir son propre nom, sinon rien ne marche. Attendez que tout soit prêt. Nous avons dû partir parce que personne n'était resté dans cette maison. Ils vont toujours avec leurs amis dans la même rue, et elle aussi.
""",
    "es": """
No se encontró el archivo. Elija otra carpeta y vuelva a intentarlo. Usted no tiene permiso para cambiar este archivo.
¿Seguro que quiere borrar los elementos seleccionados? Esta acción no se puede deshacer. El disco está lleno, primero debe liberar espacio.
No se pudo conectar con el servidor porque la red no está disponible. Pulse una tecla para seguir o espere unos segundos.
Sus cambios se han guardado. Todavía no hay nada que ver aquí, vuelva más tarde. La contraseña debe tener al menos ocho letras.
Otro programa sigue usando esta ventana. Ciérrela primero y empiece de nuevo. La actualización puede tardar unos minutos antes del próximo inicio.
El hombre viejo bajaba despacio al río con su perro. Ella nos dijo que la casa estaba vacía y la puerta abierta. Nadie sabía lo que les había pasado.
Sólo se muestran las primeras filas de la lista. El valor no es válido para este campo. Alguien ya ha abierto la última copia.
Esta función nunca se debe llamar dos veces. Quien la llama debe liberar la memoria. Esta rama nunca se toma si el resultado es falso.
El programa no puede leer la configuración sin permiso del dueño. Todavía falta revisar los datos de la pantalla mientras dure la copia. No apague los dispositivos después de este paso.
Mantenga la tecla para saltar la entrada. Demasiados intentos, vuelva mañana. El lobo duerme hasta que alguien lo despierta. Ya no es posible cambiar de cuenta.
Llovió toda la noche y el pozo viejo estaba otra vez lleno, pero el camino del norte seguía seco. Vuelva cuando haga mejor tiempo. La puerta se abre por la mañana y se cierra por la noche.
Esto pasa antes de añadir la luz a la imagen. Contamos las letras una tras otra y luego las ponemos en orden. Aquí se calcula la sombra. Tres piedras del muro están sueltas.
El servicio no responde, inténtelo más tarde. Hoy no quedan más que dos páginas en la memoria. Guarde la llave consigo.
Hace falta que usted esté allí antes que los otros. Cada usuario debe tener su propio nombre, si no nada funciona. Hay que esperar hasta que todo haya acabado. Tuvimos que irnos porque nadie había quedado en esa casa. Ellos van siempre con sus amigos por la misma calle, y ella también.
""",
    "it": """
Il file non è stato trovato. Scegliere un'altra cartella e provare di nuovo. Non avete il permesso di cambiare questo file.
Vuoi davvero eliminare gli elementi scelti? Questa azione non si può annullare. Il disco è pieno, prima bisogna liberare spazio.
Non è stato possibile collegarsi al server perché la rete non è disponibile. Premere un tasto per continuare o aspettare qualche secondo.
Le modifiche sono state salvate. Non c'è ancora niente da vedere qui, torna più tardi. La parola d'ordine deve avere almeno otto lettere.
Un altro programma usa ancora questa finestra. Prima chiuderla, poi ricominciare. L'aggiornamento può durare alcuni minuti prima del prossimo avvio.
Il vecchio scendeva piano verso il fiume con il suo cane. Lei ci disse che la casa era vuota e la porta aperta. Nessuno sapeva che cosa era successo loro.
Sono mostrate solo le prime righe dell'elenco. Il valore non è valido per questo campo. Qualcuno ha già aperto l'ultima copia.
Questa funzione non deve mai essere chiamata due volte. Chi la chiama deve liberare la memoria. Questo ramo non viene mai preso se il risultato è falso.
Il programma non riesce a leggere le impostazioni senza il consenso dell'utente. Non si possono più controllare i dati dello schermo durante la copia. Non spegnere i dispositivi.
Tenere premuto il tasto per saltare l'inizio. Troppi tentativi per oggi, basta così. Il lupo dorme finché qualcuno lo sveglia. Sei sicuro di voler lasciare il gioco?
Ha piovuto tutta la notte e il vecchio pozzo era di nuovo pieno, ma la strada del nord restava asciutta. Tornate quando il tempo è migliore. La porta si apre la mattina e si chiude la sera.
Questo succede prima che la luce venga aggiunta all'immagine. Contiamo le lettere una dopo l'altra e poi le mettiamo in ordine. Qui si calcola l'ombra. Tre pietre del muro sono rotte.
Il servizio non risponde, provare più tardi. Restano solo due pagine nella memoria. Tenga la chiave con sé.
Bisogna che voi siate lì prima degli altri. Ogni utente deve avere il suo nome, altrimenti niente funziona. Aspettate che tutto sia pronto. Siamo dovuti partire perché nessuno era rimasto in quella casa. Loro vanno sempre con i loro amici per la stessa strada, e anche lei.
""",
    "pt": """
O arquivo não foi encontrado. Escolha outra pasta e tente de novo. Você não tem a permissão para alterar este arquivo.
Quer mesmo apagar os itens escolhidos? Esta ação não pode ser desfeita. O disco está cheio, primeiro é preciso liberar espaço.
Não foi possível ligar ao servidor porque a rede não está disponível. Prima uma tecla para continuar ou espere alguns segundos.
As suas alterações foram gravadas. Ainda não há nada para ver aqui, volte mais tarde. A senha deve ter pelo menos oito letras.
Outro programa ainda usa esta janela. Feche-a primeiro e comece outra vez. A atualização pode demorar alguns minutos antes da próxima vez.
O homem velho descia devagar para o rio com o seu cão. Ela disse-nos que a casa estava vazia e a porta aberta. Ninguém sabia o que lhes tinha acontecido.
Só as primeiras linhas da lista são mostradas. O valor não é válido para este campo. Alguém já abriu a última cópia.
Esta função nunca deve ser chamada duas vezes. Quem chama deve libertar a memória. Este ramo nunca é usado se o resultado for falso.
O programa não consegue ler as configurações sem a permissão do dono. Já não se pode mudar os dados do ecrã enquanto durar a ligação. Não desligue os aparelhos depois deste passo.
Segure a tecla para saltar a entrada. Muitas tentativas por hoje, acabou. O lobo dorme até que alguém o acorde. Você ainda precisa fechar a conta.
Choveu toda a noite e o poço velho estava outra vez cheio, mas a estrada do norte continuava seca. Volte quando o tempo melhorar. O portão abre de manhã e fecha à noite.
Isto acontece antes de juntar a luz à imagem. Contamos as letras uma a uma e depois pomos tudo em ordem. Aqui calcula-se a sombra. Três pedras do muro estão soltas.
O serviço não responde, tente mais tarde. Hoje só restam duas páginas na memória. Guarde a chave consigo.
É preciso que você esteja lá antes dos outros. Cada usuário deve ter o seu próprio nome, senão nada funciona. Espere até que tudo tenha terminado. Tivemos de ir embora porque ninguém tinha ficado nessa casa. Eles vão sempre com os seus amigos pela mesma rua, e ela também.
""",
    "nl": """
Het bestand is niet gevonden. Kies een andere map en probeer het opnieuw. U heeft niet het recht om dit bestand te wijzigen.
Weet je zeker dat je de gekozen regels wilt wissen? Dit kan niet ongedaan worden gemaakt. De schijf is vol, u moet eerst ruimte maken.
Wij konden geen verbinding maken met de server omdat het netwerk niet werkt. Druk op een toets om verder te gaan of wacht enkele seconden.
Uw wijzigingen zijn opgeslagen. Er is hier nog niets te zien, kom later terug. Het wachtwoord moet ten minste acht letters hebben.
Een ander programma gebruikt dit venster nog. Sluit het eerst en begin dan opnieuw. Het kan enkele minuten duren voor de volgende start.
De oude man liep langzaam met zijn hond naar de rivier. Zij vertelde ons dat het huis leeg was en de deur open stond. Niemand wist wat er met hen was gebeurd.
Alleen de eerste regels van de lijst worden getoond. De waarde is niet geldig voor dit veld. Iemand heeft de laatste kopie al geopend.
Deze functie mag nooit twee keer worden aangeroepen. De aanroeper moet het geheugen zelf vrijgeven. Deze tak wordt nooit genomen als het resultaat fout is.
Het programma kan de instellingen niet lezen zonder toestemming van de eigenaar. Niemand mag nog de gegevens van het scherm controleren. Zet de apparaten niet uit na deze stap.
Houd de toets ingedrukt om over te slaan. Te veel pogingen voor vandaag, het is klaar. De wolf slaapt tot iemand hem wekt. Wil je het spel echt verlaten?
Het regende de hele nacht en de oude put was weer vol, maar de weg naar het noorden bleef droog. Kom terug als het weer beter is. De poort gaat in de ochtend open en 's avonds dicht.
Dit gebeurt voordat het licht aan het beeld wordt toegevoegd. We tellen de letters een voor een en zetten ze dan in de juiste volgorde. Hier wordt de schaduw berekend. Drie stenen in de muur zitten los.
De dienst geeft geen antwoord, probeer het later. Er zijn vandaag nog maar twee bladzijden over. Bewaar de sleutel goed.
U moet er voor de anderen zijn. Elke gebruiker moet een eigen naam hebben, anders werkt er niets. Wacht tot alles klaar is. Wij moesten weg omdat niemand in dat huis was gebleven. Zij gaan altijd met hun vrienden door dezelfde straat, en zij ook.
""",
    "sv": """
Filen kunde inte hittas. Välj en annan mapp och försök igen. Du har inte rätt att ändra den här filen.
Är du säker på att du vill ta bort de valda raderna? Det går inte att ångra. Disken är full, du måste först göra plats.
Vi kunde inte ansluta till servern eftersom nätet ligger nere. Tryck på en tangent för att fortsätta eller vänta några sekunder.
Dina ändringar har sparats. Det finns inget att se här än, kom tillbaka senare. Lösenordet måste ha minst åtta tecken.
Ett annat program använder fortfarande fönstret. Stäng det först och börja sedan om. Det kan ta några minuter innan nästa start.
Den gamla mannen gick långsamt ner till floden med sin hund. Hon sade oss att huset var tomt och att dörren stod öppen. Ingen visste vad som hade hänt dem.
Bara de första raderna i listan visas. Värdet är inte giltigt för fältet. Någon har redan öppnat den sista kopian.
Den här funktionen får aldrig anropas två gånger. Anroparen måste själv frigöra minnet. Den här grenen tas aldrig om resultatet är fel.
Programmet kan inte läsa inställningarna utan ägarens tillstånd. Ingen får längre spara listan över enheter medan skärmen är öppen. Stäng inte av datorn efter detta steg.
Håll knappen nere för att hoppa över. För många försök i dag, det räcker. Vargen sover tills någon väcker den. Vill du verkligen lämna spelet?
Det regnade hela natten och den gamla brunnen var full igen, men vägen norrut förblev torr. Kom tillbaka när vädret är bättre. Porten öppnas på morgonen och stängs på kvällen.
Detta sker innan ljuset läggs till bilden. Vi räknar bokstäverna en efter en och sätter dem sedan i rätt ordning. Här beräknas skuggan. Tre stenar i muren är lösa.
Tjänsten svarar inte, försök senare. Det finns bara två sidor kvar i minnet. Behåll nyckeln hos dig.
Du måste vara där före de andra. Varje användare ska ha ett eget namn, annars fungerar ingenting. Vänta tills allt är klart. Vi var tvungna att gå eftersom ingen hade stannat i det huset. De går alltid med sina vänner på samma gata, och hon också.
""",
    "pl": """
Nie znaleziono pliku. Proszę wybrać inny folder i spróbować ponownie. Nie masz prawa zmieniać tego pliku.
Czy na pewno chcesz usunąć wybrane elementy? Tego nie można cofnąć. Dysk jest pełny, najpierw trzeba zwolnić miejsce.
Nie można połączyć się z serwerem, ponieważ sieć nie działa. Naciśnij dowolny klawisz, aby kontynuować, albo poczekaj kilka sekund.
Twoje zmiany zostały zapisane. Nie ma tu jeszcze nic do zobaczenia, wróć później. Hasło musi mieć co najmniej osiem liter.
Inny program nadal używa tego okna. Najpierw je zamknij, a potem zacznij od nowa. Aktualizacja może potrwać kilka minut przed ponownym uruchomieniem.
Stary człowiek schodził powoli nad rzekę ze swoim psem. Powiedziała nam, że dom był pusty, a drzwi otwarte. Nikt nie wiedział, co się z nimi stało.
Pokazano tylko pierwsze wiersze listy. Wartość nie jest dozwolona w tym polu. Ktoś już otworzył ostatnią kopię danych.
Tej funkcji nigdy nie wolno wywołać dwa razy. Wywołujący musi sam zwolnić pamięć. Ta gałąź nigdy nie jest wybierana, gdy wynik jest zły.
Program nie zdołał odczytać ustawień bez zgody właściciela. Nie wolno już sprawdzać listy urządzeń podczas zapisu. Nie wyłączaj komputera po tym kroku.
Przytrzymaj klawisz, aby pominąć wstęp. Zbyt wiele prób na dziś, to koniec. Wilk śpi, dopóki ktoś go nie obudzi. Czy chcesz opuścić grę?
Padało całą noc i stara studnia znów była pełna, ale droga na północ pozostała sucha. Wróć, gdy pogoda będzie lepsza. Brama otwiera się rano, a zamyka wieczorem.
Dzieje się to, zanim światło zostanie dodane do obrazu. Liczymy litery jedna po drugiej, a potem układamy je w dobrej kolejności. Tutaj oblicza się cień. Trzy kamienie w murze są luźne.
Usługa nie odpowiada, spróbuj później. W pamięci zostały tylko dwie strony. Zachowaj klucz przy sobie.
Trzeba, żebyś był tam przed innymi. Każdy użytkownik musi mieć własną nazwę, inaczej nic nie działa. Poczekaj, aż wszystko będzie gotowe. Musieliśmy odejść, bo nikt nie został w tym domu. Oni zawsze chodzą ze swoimi przyjaciółmi tą samą ulicą, ona też. To pasuje do drzwi, a klucz leży na stole.
""",
    "ru": """
Файл не найден. Пожалуйста, выберите другой каталог и попробуйте ещё раз. У вас нет права изменять этот файл.
Вы действительно хотите удалить выбранные строки? Это нельзя отменить. Диск заполнен, сначала нужно освободить место.
Не удалось подключиться к серверу, потому что сеть не работает. Нажмите любую клавишу, чтобы продолжить, или подождите несколько секунд.
Ваши изменения сохранены. Здесь пока нечего смотреть, приходите позже. Пароль должен иметь не менее восьми букв.
Другая программа ещё использует это окно. Сначала закройте его, потом начните снова. Обновление может занять несколько минут перед следующим запуском.
Старик медленно спускался к реке со своей собакой. Она сказала нам, что дом был пуст, а дверь открыта. Никто не знал, что с ними случилось.
Показаны только первые строки списка. Значение не подходит для этого поля. Кто-то уже открыл последнюю копию.
Эту функцию никогда нельзя вызывать дважды. Вызывающий должен сам освободить память. Эта ветвь никогда не выполняется.
Программа не может прочитать настройки без согласия владельца. Больше нельзя проверять список устройств во время записи. Не выключайте компьютер.
Удерживайте клавишу, чтобы пропустить. Слишком много попыток на сегодня. Волк спит, пока его кто-нибудь не разбудит. Вы хотите выйти из игры?
Всю ночь шёл дождь, и старый колодец снова стал полон, но дорога на север осталась сухой. Возвращайтесь, когда погода станет лучше. Ворота открываются утром и закрываются вечером.
Это происходит до того, как к картине добавлен свет. Мы считаем буквы одну за другой, а потом ставим их в нужном порядке. Здесь вычисляется тень. Три камня в стене расшатались.
Служба не отвечает, попробуйте позже. В памяти осталось только две страницы. Храните ключ у себя.
""",
    "zh": """
找不到该文件。请选择其他文件夹然后再试一次。您没有权限修改这个文件。您确定要删除所选的项目吗？此操作无法撤销。磁盘已满，请先清理空间。
无法连接服务器，因为网络不可用。按任意键继续，或者等待几秒钟。您的更改已经保存。这里还没有任何内容，请稍后再来。密码至少要有八个字符。
另一个程序仍在使用这个窗口。请先关闭它，然后重新启动程序。更新可能需要几分钟。老人带着他的狗慢慢走到河边。她告诉我们房子是空的，门开着。没有人知道他们发生了什么事。
只显示列表的前几行。该值对此字段无效。有人已经打开了最后的备份。这个函数不能调用两次。调用者必须自己释放内存。程序不能读取设置，否则数据会丢失。
不能再检查打印机的设备列表。今天尝试次数太多，到此为止。狼一直睡到有人叫醒它。您要离开游戏吗？下雨后再来。请勿关闭电脑。
昨晚下了一夜的雨，老井又满了，但是往北的路还是干的。天气好的时候再来。大门早上打开，晚上关闭。在图像加上光线之前先计算阴影。我们一个一个地数字母，然后按正确的顺序排列。墙上有三块石头松了。
""",
    "ja": """
ファイルが見つかりません。別のフォルダを選択してもう一度お試しください。このファイルを変更する権限がありません。選択した項目を本当に削除しますか。この操作は元に戻せません。ディスクがいっぱいです。
ネットワークが使えないためサーバーに接続することができませんでした。続けるには何かキーを押すか、数秒お待ちください。変更を保存しました。ここにはまだ何もありません。後でまた来てください。パスワードは八文字以上でなければなりません。
別のプログラムがまだこのウィンドウを使っています。先に閉じてから、もう一度始めてください。更新には数分かかることがあります。老人は犬を連れてゆっくり川へ下りていきました。家は空で、戸が開いていたと彼女は言いました。
一覧の最初の行だけを表示しています。この欄の値が正しくありません。誰かが最後の記録をすでに開いています。この関数を二度呼び出してはいけません。メモリは呼び出し側で解放してください。
設定を読み込むことがまだできません。確認してください。今日は試行回数が多すぎます。狼は誰かが起こすまで眠ります。本当にゲームをやめますか。電源を切らないでください。
一晩中雨が降って古い井戸はまたいっぱいになりましたが、北へ行く道は乾いていました。天気がよくなったらまた来てください。門は朝開いて夜閉まります。光を加える前に影を計算します。文字を一つずつ数えてから正しい順に並べます。
""",
}

CODE = """
if (value != nullptr) { return value->next(); } else { break; } for (int i = 0; i < count; ++i) { sum += array[i]; }
SELECT id, name FROM table WHERE id = ? AND name IS NOT NULL ORDER BY 1 LIMIT 10; INSERT INTO log (a, b) VALUES (:low, :high); UPDATE t SET x = 1
#include <vector> #define MAX_SIZE 1024 #version 330 uniform vec4 color; void main() { gl_FragColor = color; } assert(ptr != NULL && size > 0);
https://api.server.example/v1/path?id=12&page=next https://files.host.test/a/b /usr/local/lib/name.so.2 C:\\\\data\\\\file.tmp ../share/name.json assets/icon.dat
net.core.max_ms io.buffer.size gpu.cache.enabled ui.window.count ClassName::methodName getValue setValue on_event_name MAX_COUNT ERR_1024 E2001
text/plain application/json image/png <div class='row'></div> <item id='3'/> {\\"key\\":12,\\"list\\":[]} %d/%d %-12s|%8.3f %s=%s; 0x%08x [%d] --flag=<n> --name-value -o
one,two,three,four red green blue alpha north south east west alpha beta gamma delta abc def ghi jkl size count index name type key value node
^[A-Za-z_]\\\\w+(a|b)$ ^[0-9]{2,4} std::string const auto& static inline template <typename T> namespace class struct enum virtual override public private
"""
